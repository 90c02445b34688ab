"""Secret scans with multipart credential linking. DataFrame operations only, no shuffle.

Strong parts (assigned secrets, access keys, long hexadecimal strings) are reported wherever they
stand. Weak parts - login names, short assigned secrets, long base64 runs, endpoints - say nothing
by themselves: an interval join within a document links access identifiers, secrets and endpoints,
and a weak part is reported only when other parts that complete it stand in its scope:

* a login needs a secret,
* a weak secret needs an access identifier or an endpoint,
* an endpoint needs an access identifier and a secret.

Two parts are in one scope when they don't overlap, at most ``reach`` code points lie between the
end of one and the start of the other, and nothing that ends a scope (``ends``, by default a blank
line) lies between them. So a part, or what it contains, never completes itself, and a long part
doesn't push its neighbour away.

The join is a sweep over the starts and ends of parts in order, once forward and once backward: a
running maximum of the ends of each role, forgotten where a scope ends, tells each part how far
the last one of that role is. Running maxima are made chunk by chunk, so a document with very many
parts costs little more than sorting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


def _assigned(names: list[str], value: str) -> str:
    return "(" + "|".join(_either_case(n) for n in names) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


ASSIGN = _assigned(["password", "passwd", "secret", "token", "api_?key"], r"[A-Za-z0-9+/_.=-]+")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LOGIN = _assigned(["login", "username", "user", "account", "client_id"], r"[A-Za-z0-9_.@-]{3,}")
BLOB = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D"'<>]{4,}"""
#: Kinds in the order in which they are listed where spans start together, with the role of each.
KINDS = ["assign", "access", "hex", "weak_assign", "login", "blob", "endpoint"]
ROLES = {"assign": "secret", "access": "access", "hex": "secret", "weak_assign": "secret", "login": "access", "blob": "secret", "endpoint": "endpoint"}
BASE = KINDS[:3]
ROLE_NAMES = ["access", "secret", "endpoint"]
#: Code points between the end of a part and the start of the next one that belongs to it, at most.
REACH = 200
#: What ends a scope: a blank line.
ENDS = r"\n[\x20\x09\x0D]*\n"
CHUNK = 64
#: Before any position.
NOWHERE = -(2**30)


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once, however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(steps: Column, start: Column, merge) -> Column:
    """The merge of the steps up to each place, chunk by chunk; steps must be bound, and not empty."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))
    upto = F.aggregate(chunks, F.array(start), lambda acc, c: F.concat(acc, F.array(F.aggregate(F.slice(steps, c * CHUNK + 1, CHUNK), F.element_at(acc, -1), merge))))

    def all_places(found: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            return F.aggregate(F.slice(steps, chunk * CHUNK + 1, i % CHUNK + 1), F.element_at(found, chunk + 1), merge)

        return F.transform(steps, at)

    return _let(upto, all_places)


def _matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches, of which there must be one: array of (text, start, end), in code points."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(between, found, lambda b, m: F.struct((F.length(b) + F.length(m)).alias("n"), F.length(m).alias("m")))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("m"))
        ends = _let(steps, lambda s: _running(s, start, lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), y["m"].alias("m"))))
        return F.zip_with(found, ends, lambda t, e: F.struct(t.alias("t"), (e["n"] - e["m"]).alias("start"), e["n"].alias("end")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _part(kind: str, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(ROLES[kind]).alias("role"))


NO_PARTS = "array<struct<start:int,rank:int,end:int,kind:string,role:string>>"


def _parts(text: Column, pattern: str, pick) -> Column:
    """Parts of a pattern; the costly form only where there is a match at all."""
    return F.when(text.rlike(pattern), pick(_matches(text, pattern))).otherwise(F.array().cast(NO_PARTS))


def _last_ends(parts: Column, breaks: Column, start, end) -> Column:
    """For each part, the greatest end of each role before its start, in its scope: by the order of parts.

    start and end give the borders of a part or break; both negated and exchanged, they look ahead.
    """
    ends = F.transform(parts, lambda p: F.struct(end(p).alias("pos"), F.lit(0).alias("step"), F.lit(-1).alias("part"), p["role"].alias("role")))
    stops = F.transform(breaks, lambda b: F.struct(start(b).alias("pos"), F.lit(1).alias("step"), F.lit(-1).alias("part"), F.lit("").alias("role")))
    asks = F.transform(parts, lambda p, i: F.struct(start(p).alias("pos"), F.lit(2).alias("step"), i.alias("part"), F.lit("").alias("role")))
    events = F.sort_array(F.concat(ends, stops, asks))
    none = F.lit(NOWHERE)
    steps = F.transform(events, lambda e: F.struct((e["step"] == 1).alias("stop"), e["part"].alias("part"), *[F.when((e["step"] == 0) & (e["role"] == r), e["pos"]).otherwise(none).alias(r) for r in ROLE_NAMES]))
    first = F.struct(F.lit(False).alias("stop"), F.lit(-1).alias("part"), *[none.alias(r) for r in ROLE_NAMES])

    def merge(a: Column, b: Column) -> Column:
        return F.struct(b["stop"].alias("stop"), b["part"].alias("part"), *[F.when(b["stop"], none).otherwise(F.greatest(a[r], b[r])).alias(r) for r in ROLE_NAMES])

    asked = F.filter(_let(steps, lambda s: _running(s, first, merge)), lambda e: e["part"] >= 0)
    return F.sort_array(F.transform(asked, lambda e: F.struct(e["part"].alias("part"), *[e[r].alias(r) for r in ROLE_NAMES])))


def _linked(parts: Column, breaks: Column, reach: int) -> Column:
    """The parts that are strong, or weak and completed in their scope; parts must not be empty."""
    before = _last_ends(parts, breaks, lambda p: p["start"], lambda p: p["end"])
    behind = _last_ends(parts, breaks, lambda p: -p["end"], lambda p: -p["start"])
    seen = F.zip_with(before, behind, lambda a, b: F.struct(*[F.struct(a[r].alias("before"), b[r].alias("behind")).alias(r) for r in ROLE_NAMES]))

    def keep(x: Column) -> Column:
        p = x["p"]

        def has(role: str) -> Column:
            return (x["seen"][role]["before"] >= p["start"] - reach) | (x["seen"][role]["behind"] >= -p["end"] - reach)

        weak = F.when(p["kind"] == "login", has("secret")).when(p["kind"] == "endpoint", has("access") & has("secret")).otherwise(has("access") | has("endpoint"))
        return (p["rank"] < len(BASE)) | weak

    both = F.zip_with(parts, seen, lambda p, s: F.struct(p.alias("p"), s.alias("seen")))
    return F.transform(F.filter(both, keep), lambda x: x["p"])


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text", reach: int = REACH, ends: str | None = ENDS) -> DataFrame:
    """docs with secrets: array of (start, rank, end, kind, role) by start and kind.

    ends is a pattern of what ends a scope, such as "\\n" for lines; None: distance alone does.
    Whole texts are read; a null text counts as empty and has none. Rows that repeat are scanned
    each. A column secrets that docs has already is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def assigned(ms: Column) -> Column:
        long = lambda m: F.length(F.regexp_extract(m["t"], ASSIGN, 2))
        strong = F.transform(F.filter(ms, lambda m: long(m) >= 12), lambda m: _part("assign", m))
        weak = F.transform(F.filter(ms, lambda m: (long(m) >= 4) & (long(m) < 12)), lambda m: _part("weak_assign", m))
        return F.concat(strong, weak)

    found = F.concat(
        _parts(text, ASSIGN, assigned),
        _parts(text, ACCESS, lambda ms: F.transform(F.filter(ms, lambda m: m["end"] - m["start"] >= 18), lambda m: _part("access", m))),
        _parts(text, HEX, lambda ms: F.transform(ms, lambda m: _part("hex", m))),
    )
    weak = F.concat(*[_parts(text, p, lambda ms, k=k: F.transform(ms, lambda m: _part(k, m))) for k, p in (("login", LOGIN), ("blob", BLOB), ("endpoint", ENDPOINT))])
    staged = docs.withColumn("_llm_parts", F.sort_array(F.concat(found, weak)))
    parts, none = F.col("_llm_parts"), F.array().cast("array<struct<start:int,end:int>>")
    breaks = none if ends is None else F.when(text.rlike(ends), F.transform(_matches(text, ends), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))).otherwise(none)
    some_weak = F.exists(parts, lambda p: p["rank"] >= len(BASE))
    return staged.withColumn("secrets", F.when(some_weak, _let(breaks, lambda b: _linked(parts, b, reach))).otherwise(parts)).drop("_llm_parts")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda p: p["rank"] < len(BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _sql_kind(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name}_m AS (
  SELECT i, unnest(regexp_extract_all(t, '{quoted}')) AS m, unnest(string_split_regex(t, '{quoted}')[:-2]) AS b,
         unnest(range(len(regexp_extract_all(t, '{quoted}')))) AS k FROM d
), {name}_s AS (
  SELECT i, m, sum(length(b) + length(m)) OVER (PARTITION BY i ORDER BY k) - length(m) AS s, sum(length(b) + length(m)) OVER (PARTITION BY i ORDER BY k) AS e FROM {name}_m
)"""


def _sql() -> str:
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "blob": BLOB, "endpoint": ENDPOINT}
    value = f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2))"
    where = {"assign": f"{value} >= 12", "access": "length(m) >= 18"}
    picks = [f"SELECT i, s, e, {KINDS.index(k)} AS r, '{k}' AS kind, '{ROLES[k]}' AS role FROM {k}_s WHERE {where.get(k, 'true')}" for k in kinds]
    picks.append(f"SELECT i, s, e, 3, 'weak_assign', 'secret' FROM assign_s WHERE {value} BETWEEN 4 AND 11")
    apart = f"((q.s >= p.e AND q.s - p.e <= {REACH} AND NOT EXISTS (SELECT 1 FROM ends_s AS b WHERE b.i = p.i AND b.s >= p.e AND b.e <= q.s)) OR (p.s >= q.e AND p.s - q.e <= {REACH} AND NOT EXISTS (SELECT 1 FROM ends_s AS b WHERE b.i = p.i AND b.s >= q.e AND b.e <= p.s)))"
    pairs = f"SELECT DISTINCT p.i, p.s, p.e, p.r, q.role FROM p JOIN p AS q ON q.i = p.i WHERE p.r >= 3 AND {apart}"
    near = "'%s' IN (SELECT l.role FROM links AS l WHERE l.i = p.i AND l.s = p.s AND l.e = p.e AND l.r = p.r)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(_sql_kind(k, p) for k, p in (kinds | {"ends": ENDS}).items())},
p AS ({" UNION ALL ".join(picks)}),
links AS ({pairs}),
kept AS (
  SELECT * FROM p WHERE r < 3 OR CASE kind WHEN 'login' THEN {near % "secret"} WHEN 'endpoint' THEN {near % "access"} AND {near % "secret"}
    ELSE {near % "access"} OR {near % "endpoint"} END
), g AS (
  SELECT i, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, r) FILTER (r < 3), '') AS base,
    string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, r) AS spans
  FROM kept GROUP BY i
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (i)
"""


SQL = _sql()
