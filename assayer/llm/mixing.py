"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Every source has a weight schedule w(t) over training time t in [0, 1]: knots (t, weight) joined by
straight lines. Its integral, piece by piece, is the source's weight, which its target follows, and
scaled to the target it is the source's cumulative token demand D(t). Where no schedule is given,
the source of rank r has the knots (0, w * (1 - s)) and (1, w * (1 + s)) of its weight w and slope
s: whether it comes early, evenly or late. A source is cut into strata by the size of its documents,
which share its target; documents of a stratum stand in the order of a hash of their id. A copy
whose middle lies at the share x of the stratum's target (later passes continue behind the first)
is trained on at the t with D(t) = x * target; copies up to x = 1 are taken, and the mix is sorted
by t over ranges. What whole documents leave over or short in a stratum goes to the strata of
smaller ones, so that a source ends within half a small document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import words, written

#: No source and no document is repeated more often.
MAX_EPOCHS = 3
#: Hex digits of the hash that split a source's order into parts: 16**3 parts of any source.
PART_DIGITS = 3
#: Documents of more words than the first, than the second, and all others are the strata.
STRATA = (1024, 128)


def weight_of(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the rank of a source."""
    return rank % 3 + 1


def slope_of(rank: Column) -> Column:
    """-0.5, 0, 0.5, ...: whether a source comes early, evenly or late."""
    return (rank % 3 - 1) / F.lit(2.0)


PIECE = "array<struct<t:double,width:double,start:double,rise:double,before:double>>"


def schedules(sources: DataFrame, knots: DataFrame | None = None) -> DataFrame:
    """Of (skey): rank, weight and pieces of each source's schedule; knots are (source, t, weight).

    A piece has its start in time and its width, the weight at its start, half its slope, and the
    integral before it. Before its first knot and behind its last one a schedule is level. Knots
    outside [0, 1] and without numbers don't count, negative weights count as 0; of knots at one
    time the greatest counts. A source without knots has its rank's default.
    """
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    ranked = sources.select("skey").withColumn("rank", rank)
    w, s = weight_of(F.col("rank")).cast("double"), slope_of(F.col("rank"))
    pair = lambda t, weight: F.struct(t.cast("double").alias("t"), weight.cast("double").alias("w"))
    listed = F.array(pair(F.lit(0), w * (1 - s)), pair(F.lit(1), w * (1 + s)))
    if knots is not None:
        key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
        real = knots.filter("t between 0 and 1 and weight is not null and not isnan(weight)").groupBy(key.alias("k_skey"), "t").agg(F.max(F.greatest("weight", F.lit(0))).alias("w"))
        given = real.groupBy("k_skey").agg(F.sort_array(F.collect_list(pair(F.col("t"), F.col("w")))).alias("k"))
        ranked = ranked.join(given, F.col("skey") == F.col("k_skey"), "left").drop("k_skey")
        first, last = F.element_at("k", 1), F.element_at("k", -1)
        listed = F.when(F.col("k").isNull(), listed).otherwise(F.concat(F.array(pair(F.lit(0), first["w"])), F.col("k"), F.array(pair(F.lit(1), last["w"]))))
    ranked = ranked.withColumn("knots", listed)
    between = F.zip_with(F.slice("knots", 1, F.size("knots") - 1), F.slice("knots", 2, F.size("knots") - 1), lambda a, b: F.struct(a["t"].alias("t"), (b["t"] - a["t"]).alias("width"), a["w"].alias("start"), b["w"].alias("end")))
    wide = F.filter(between, lambda p: p["width"] > 0)
    empty = F.struct(F.array().cast(PIECE).alias("pieces"), F.lit(0.0).alias("total"))

    def add(held: Column, p: Column) -> Column:
        made = F.struct(p["t"].alias("t"), p["width"].alias("width"), p["start"].alias("start"), ((p["end"] - p["start"]) / (2 * p["width"])).alias("rise"), held["total"].alias("before"))
        return F.struct(F.concat(held["pieces"], F.array(made)).alias("pieces"), (held["total"] + p["width"] * (p["start"] + p["end"]) / 2).alias("total"))

    done = ranked.withColumn("schedule", F.aggregate(wide, empty, add))
    return done.select("skey", "rank", F.col("schedule.total").alias("weight"), F.col("schedule.pieces").alias("pieces"))


def targets(sources: DataFrame, total_share: float = 1.0, knots: DataFrame | None = None) -> DataFrame:
    """Of (skey, source_size): rank, weight, pieces and target of each source.

    The targets share total_share of all words by weight; a target stops at MAX_EPOCHS times the
    source's size and the excess is shared again by weight, until none is above. In closed form:
    with sources by size/weight, the level at the first source that it doesn't fill. One row for
    each source goes through a single sort; documents never do. A source of weight 0 gets nothing.
    """
    planned = schedules(sources, knots).withColumnRenamed("skey", "s_skey")
    ranked = sources.join(planned, F.col("skey") == F.col("s_skey")).drop("s_skey")
    ranked = ranked.withColumn("cap", F.when(F.col("weight") > 0, F.lit(MAX_EPOCHS) * F.col("source_size")).otherwise(F.lit(0)).cast("long"))
    fill = Window.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))), "rank")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    demand = F.sum("source_size").over(all_rows) * F.lit(total_share)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", F.try_divide((demand - before).cast("double"), still.cast("double"))).withColumn("place", F.row_number().over(fill))
    met = F.col("level") * F.col("weight") <= F.col("cap")
    level = level.withColumn("level", F.min_by(F.when(met, F.col("level")), F.when(met, F.col("place"))).over(all_rows))
    return level.select("skey", "rank", "weight", "pieces", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _count(middle2: Column, stratum_size: Column, quota: Column) -> Column:
    """How many passes over a stratum reach a document before its quota ends."""
    return sum((F.when(middle2 + 2 * e * stratum_size <= 2 * quota, 1).otherwise(0) for e in range(MAX_EPOCHS)), F.lit(0))


def _middles(rows: DataFrame, parts: DataFrame, id_col: str) -> DataFrame:
    """rows with what parts has of their source, stratum and part, and twice the middle of each in its stratum."""
    same = (F.col("_llm_skey") == F.col("p_skey")) & (F.col("_llm_stratum") == F.col("p_stratum")) & (F.col("_llm_part") == F.col("p_part"))
    run = Window.partitionBy("_llm_skey", "_llm_stratum", "_llm_part").orderBy("_llm_order", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, same).withColumn("_llm_mid", (F.col("p_start") + F.coalesce(F.sum("size").over(run), F.lit(0))) * 2 + F.col("size"))


def _quotas(narrow: DataFrame, id_col: str, knots: DataFrame | None) -> DataFrame:
    """A row for each source, stratum and part: sizes, target, schedule, the part's start and the stratum's quota."""
    parts = narrow.groupBy("_llm_skey", "_llm_stratum", "_llm_part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("_llm_skey", "_llm_stratum").orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_llm_skey").alias("p_skey"), F.col("_llm_stratum").alias("p_stratum"), F.col("_llm_part").alias("p_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p_start"))
    n = len(STRATA) + 1
    sizes = parts.groupBy(F.col("_llm_skey").alias("skey")).agg(F.sum("n").alias("source_size"), *[F.sum(F.when(F.col("_llm_stratum") == k, F.col("n")).otherwise(0)).alias(f"p_size{k}") for k in range(n)])
    shares = targets(sizes.select("skey", "source_size"), knots=knots).select(F.col("skey").alias("t_skey"), "target", F.col("pieces").alias("p_pieces"), F.col("weight").alias("p_weight"))
    sizes = sizes.join(shares, F.col("skey") == F.col("t_skey")).drop("t_skey").withColumn("p_taken", F.lit(0).cast("long"))
    out = None
    for k in range(n):
        size, upto = F.col(f"p_size{k}"), sum((F.col(f"p_size{j}") for j in range(k + 1)), F.lit(0))
        due = F.col("target") if k == n - 1 else F.when(F.col("source_size") > 0, F.col("target") * upto / F.col("source_size")).otherwise(F.lit(0.0))
        quota = F.least(F.greatest(due - F.col("p_taken"), F.lit(0.0)), (MAX_EPOCHS * size).cast("double"))
        here = starts.filter(F.col("p_stratum") == k).join(sizes.withColumn("p_quota", quota), F.col("p_skey") == F.col("skey"))
        here = here.select("p_skey", "p_stratum", "p_part", "p_start", "source_size", "target", "p_pieces", "p_weight", size.alias("p_size"), "p_quota")
        out = here if out is None else out.unionByName(here)
        if k < n - 1:
            rows = _middles(narrow.filter(F.col("_llm_stratum") == k), here.drop("source_size"), id_col)
            taken = rows.groupBy(F.col("_llm_skey").alias("t_skey")).agg(F.sum(_count(F.col("_llm_mid"), F.col("p_size"), F.col("p_quota")) * F.col("size")).alias("t_taken"))
            sizes = sizes.join(taken, F.col("skey") == F.col("t_skey"), "left").withColumn("p_taken", F.col("p_taken") + F.coalesce("t_taken", F.lit(0))).drop("t_skey", "t_taken")
            sizes = written(sizes, "mix-sources")
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", knots: DataFrame | None = None) -> DataFrame:
    """docs with size, source_size, target, copies (0 to 3), taken, position and positions.

    size: words of the text, 0 for a null one. A null source is one more source, the last. taken:
    copies * size. position: the training time of the first copy, null where there is none;
    positions has that of every copy. A document without words takes part with 0 words. Rows that
    repeat an id stand side by side, by size, and are taken each; a null id is one more id. Columns
    of these names that docs has already are replaced. knots (source, t, weight) are schedules of
    sources' own; see schedules().

    A stratum's order is cut into 16**PART_DIGITS parts by hash, the parts are summed, and running
    sums are made within parts: no task holds a source. Ids and sizes are written once.
    """
    skey = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    order = F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    rows = docs.drop("source_size", "target").withColumns({"size": F.size(words(F.col(text_col))).cast("long"), "_llm_skey": skey, "_llm_order": order})
    stratum = F.when(F.col("size") > STRATA[0], 0).when(F.col("size") > STRATA[1], 1).otherwise(2)
    rows = rows.withColumns({"_llm_part": F.substring("_llm_order", 1, PART_DIGITS), "_llm_stratum": stratum})
    narrow = written(rows.select(id_col, "size", "_llm_skey", "_llm_order", "_llm_part", "_llm_stratum"), "mix-sizes")
    at = _middles(rows, written(_quotas(narrow, id_col, knots), "mix-quotas"), id_col)
    mid, size, quota = F.col("_llm_mid"), F.col("p_size"), F.col("p_quota")
    times = [_time(mid + 2 * e * size, quota) for e in range(MAX_EPOCHS)]
    out = at.withColumn("copies", _count(mid, size, quota).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("position", F.when(F.col("copies") > 0, times[0]))
    out = out.withColumn("positions", F.slice(F.array(*times), 1, F.col("copies")))
    return out.drop(*[c for c in out.columns if c.startswith(("_llm_", "p_")) and c not in docs.columns])


def _time(middle2: Column, quota: Column) -> Column:
    """The t at which the schedule's integral is the share middle2 / (2 * quota) of the whole; 0 where there is no quota.

    In the last piece that begins below the share, start * d + rise * d * d is what it lacks.
    """
    due = F.when(quota > 0, middle2 / (2 * quota)).otherwise(F.lit(0.0)) * F.col("p_weight")
    piece = F.element_at(F.filter("p_pieces", lambda p: (p["before"] < due) | (p["t"] == 0)), -1)
    lack = due - piece["before"]
    root = piece["start"] + F.sqrt(F.greatest(piece["start"] * piece["start"] + 4 * piece["rise"] * lack, F.lit(0.0)))
    return F.when(lack <= 0, piece["t"]).otherwise(F.least(piece["t"] + F.least(2 * lack / root, piece["width"]), F.lit(1.0)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", knots: DataFrame | None = None) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, with its position, sorted by it over ranges."""
    plan = plan_mix(docs, id_col, source_col, text_col, knots)
    kept = [c for c in docs.columns if c not in ("position", "size", "source_size", "target", "copies", "taken", "positions")]
    return by_position(plan.select(*kept, F.explode("positions").alias("position")))


def by_position(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "position").sortWithinPartitions("position")


def digest(docs: DataFrame) -> DataFrame:
    """For each document: size, source_size, target, taken, and the training time of its first copy.

    Documents that the mix doesn't take are dealt behind it by id.
    """
    plan = plan_mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    last = F.coalesce(F.col("position"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return plan.withColumn("_llm_last", last).repartitionByRange(parts, "_llm_last").sortWithinPartitions("_llm_last").drop("_llm_last")


SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey
), r AS (
  SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rank FROM s
), w AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM r
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
         row_number() OVER (ORDER BY cap / weight, rank) AS place FROM w
), t AS (
  SELECT skey, rank, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1) * weight) AS target FROM l
), m AS (
  SELECT doc_id, size, source_size, target, d.skey, (rank % 3 + 1) * (1 - (rank % 3 - 1) / 2.0::DOUBLE) AS w0, (rank % 3 + 1) * ((rank % 3 - 1) / 2.0::DOUBLE) AS rise, CAST(rank % 3 + 1 AS DOUBLE) AS w, k, sum(size) OVER (PARTITION BY d.skey, k) AS zk,
         2 * coalesce(sum(size) OVER (PARTITION BY d.skey, k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS mid
  FROM (SELECT *, CASE WHEN size > 1024 THEN 0 WHEN size > 128 THEN 1 ELSE 2 END AS k FROM d) AS d JOIN t USING (skey)
), z AS (
  SELECT skey, any_value(target) AS target, any_value(source_size) AS z, coalesce(sum(size) FILTER (k = 0), 0) AS z0, coalesce(sum(size) FILTER (k = 1), 0) AS z1, coalesce(sum(size) FILTER (k = 2), 0) AS z2 FROM m GROUP BY skey
), q0 AS (
  SELECT *, least(greatest(CASE WHEN z > 0 THEN target * z0 / z ELSE 0.0 END, 0.0), CAST(3 * z0 AS DOUBLE)) AS q0 FROM z
), t0 AS (
  SELECT skey, sum(size * (CAST(mid <= 2 * q0 AS INT) + CAST(mid + 2 * zk <= 2 * q0 AS INT) + CAST(mid + 4 * zk <= 2 * q0 AS INT))) AS t0 FROM m JOIN q0 USING (skey) WHERE k = 0 GROUP BY skey
), q1 AS (
  SELECT *, coalesce(t0, 0) AS done0, least(greatest(CASE WHEN z > 0 THEN target * (z0 + z1) / z ELSE 0.0 END - coalesce(t0, 0), 0.0), CAST(3 * z1 AS DOUBLE)) AS q1 FROM q0 LEFT JOIN t0 USING (skey)
), t1 AS (
  SELECT skey, sum(size * (CAST(mid <= 2 * q1 AS INT) + CAST(mid + 2 * zk <= 2 * q1 AS INT) + CAST(mid + 4 * zk <= 2 * q1 AS INT))) AS t1 FROM m JOIN q1 USING (skey) WHERE k = 1 GROUP BY skey
), q2 AS (
  SELECT *, least(greatest(target - (done0 + coalesce(t1, 0)), 0.0), CAST(3 * z2 AS DOUBLE)) AS q2 FROM q1 LEFT JOIN t1 USING (skey)
), q AS (
  SELECT m.*, CASE k WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS q FROM m JOIN q2 USING (skey)
), c AS (
  SELECT *, CAST(mid <= 2 * q AS INT) + CAST(mid + 2 * zk <= 2 * q AS INT) + CAST(mid + 4 * zk <= 2 * q AS INT) AS copies,
         CASE WHEN q > 0 THEN CAST(mid AS DOUBLE) / (2 * q) ELSE 0.0 END * w AS due FROM q
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies,
       CASE WHEN copies > 0 THEN CASE WHEN due <= 0 THEN 0.0 ELSE least(2 * due / (w0 + sqrt(w0 * w0 + 4 * rise * due)), 1.0) END END AS position
FROM c
"""
