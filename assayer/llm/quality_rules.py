"""Quality rules: a threshold table compiled into one projection. DataFrame operations only.

MEASURES names what is measured of a text, RULES the bounds. compile_rules() turns the table into
one boolean column; the whole operator is a projection of the scan, with no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import words

# Frequent short words of the languages of the corpus (en, fr, de, es).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "this", "from", "or", "an"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "plus", "ne", "pas"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "im", "nicht", "ein", "eine", "auf", "als", "für", "sich", "dem", "des", "auch"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "es", "se", "no", "al", "lo", "su", "como"],
}


@dataclass(frozen=True)
class Rule:
    """A bound on a measure: least and most are both allowed values; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Ratios to words, lines or code points of words. A text fails with any measure out of bounds.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", most=0.3),
    Rule("bang_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.4),
)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures.

    A null text has no words. Columns of these names that docs has already are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_llm_w": words(F.col(text_col)), "_llm_l": lines})
    w = F.col("_llm_w")
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_llm_h", F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    h = F.col("_llm_h")
    # only a text that has a window twice needs the windows in order
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn("_llm_o", F.coalesce(ordered, F.array().cast("array<struct<h:bigint,i:int>>")))
    o = F.col("_llm_o")
    again = F.filter(o, lambda x, i: ((i > 0) & (x["h"] == F.get(o, i - 1)["h"])) | F.coalesce(x["h"] == F.get(o, i + 1)["h"], F.lit(False)))
    out = out.withColumn("_llm_r", F.sort_array(F.transform(again, lambda x: x["i"])))
    r = F.col("_llm_r")
    covered = F.aggregate(F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    stops = sorted({s for group in STOP_WORDS.values() for s in group})
    counted = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_llm_l") - F.size(F.array_distinct("_llm_l")),
        "n_repeat_words": covered,
        "_llm_stops": F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(stops))),
        "_llm_bangs": F.regexp_count(text, F.lit(r"!")),
        "_llm_lines": F.size("_llm_l"),
    }
    out = out.withColumns({k: v.cast("long") for k, v in counted.items()})
    some = F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "mean_word_length": F.col("word_chars") / some,
        "symbol_ratio": F.col("n_symbols") / some,
        "bang_ratio": F.col("_llm_bangs") / some,
        "stop_word_ratio": F.col("_llm_stops") / some,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_llm_lines"), F.lit(1)),
    }
    return out.withColumns(ratios).drop("_llm_w", "_llm_l", "_llm_h", "_llm_o", "_llm_r", "_llm_stops", "_llm_bangs", "_llm_lines")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True for a text within every bound."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok &= F.col(r.measure) >= r.least
        if r.most is not None:
            ok &= F.col(r.measure) <= r.most
    return ok


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure(docs) with base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows. kept: not
    base_failed and within the rules. An empty text fails.
    """
    out = measure(docs, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def digest(docs: DataFrame) -> DataFrame:
    return apply_rules(docs.select("doc_id", "text")).drop("text")


def _sql() -> str:
    stops = ", ".join(f"'{s}'" for s in sorted({s for group in STOP_WORDS.values() for s in group}))
    bounds = [f"{r.measure} >= {r.least}" for r in RULES if r.least is not None] + [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT i, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, unnest(range(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')))) AS k FROM d),
g AS (SELECT i, k, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY i ORDER BY k)),
r AS (SELECT i, k FROM (SELECT i, k, count(*) OVER (PARTITION BY i, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1),
c AS (SELECT i, CAST(sum(least(3, coalesce(nk - k, 3))) AS BIGINT) AS n FROM (SELECT i, k, lead(k) OVER (PARTITION BY i ORDER BY k) AS nk FROM r) GROUP BY i),
l AS (SELECT i, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT i, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY i),
s AS (SELECT i, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (lower(rtrim(w, '.,;:!?')) IN ({stops})) AS stops FROM w GROUP BY i),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, greatest(coalesce(n_words, 0), 1) AS u,
    coalesce(stops, 0) AS stops, len(regexp_extract_all(t, '!')) AS bangs, greatest(coalesce(l.n, 0), 1) AS nl
  FROM d LEFT JOIN s USING (i) LEFT JOIN c USING (i) LEFT JOIN l USING (i)
), f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word_chars / u AS mean_word_length, n_symbols / u AS symbol_ratio, bangs / u AS bang_ratio,
    stops / u AS stop_word_ratio, n_dup_lines / nl AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM f
"""


SQL = _sql()
