"""Text-similarity slices: documents, TF-IDF, sparse vectors, canonical numbers. See vectors.py for reduction and k-means."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ids import sha256
from assayer.functions.json_text import fixed_object, quote
from assayer.functions.ordering import document_index, ordered_digest
from assayer.functions.shared import written
from assayer.functions.text import ASCII
from assayer.operators.vectors import ClusteringError, decomposed, distinct, kmeans, stored_vectors

__all__ = [
    "ClusteringError",
    "canonical_numbers",
    "decomposed",
    "distinct",
    "distinct_vectors",
    "document_hash",
    "document_index",
    "document_text",
    "kmeans",
    "source_manifest",
    "sparse_vectors",
    "stored_vectors",
    "terms",
    "tfidf",
]

def document_text(prompt: Column, context_json: Column) -> Column:
    """The text that is clustered: the prompt, with the canonical context below it unless that is empty."""
    whole = F.concat(F.lit("PROMPT:\n"), prompt, F.lit("\nCONTEXT_JSON:\n"), context_json)
    return F.when(F.coalesce(context_json, F.lit("{}")) == "{}", prompt).otherwise(whole)


def source_manifest(traces: DataFrame) -> str:
    """The digest of traces (trace_id, document_hash, source_trace_hash) in the order of trace_id."""
    record = fixed_object(document_hash=quote(F.col("document_hash")), source_trace_hash=quote(F.col("source_trace_hash")), trace_id=quote(F.col("trace_id")))
    return ordered_digest(traces, record, F.col("trace_id"))


def document_hash(text: Column) -> Column:
    return sha256(text)


@F.pandas_udf(T.StringType())
def _plain(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def terms(text: Column) -> Column:
    """Words of two or more word characters, lower-cased without accents, and pairs of neighbours."""
    lower = F.lower(text)
    ascii_only = lower.rlike(ASCII)
    plain = F.when(ascii_only, lower).otherwise(_plain(F.when(~ascii_only, lower)))
    found = F.regexp_extract_all(plain, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pair = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    both = lambda w: F.concat(w, F.when(F.size(w) > 1, pair(w)).otherwise(F.array().cast("array<string>")))
    return F.get(F.transform(F.array(found), both), F.lit(0))  # the words are looked for once


def tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, df, weight): 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, rows of norm 1.

    Terms are counted within a document before they travel; only the counts of documents are
    joined back, by term.
    """
    n = docs.count()
    counted = docs.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    frequency = counted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    raw = counted.join(frequency, "term").withColumn("raw", (1 + F.log("tf")) * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", (F.col("raw") / norm).alias("weight"))


def sparse_vectors(weights: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """(rows of stored_vectors(), number of terms): a vector for each of ids (id), without components where it has no terms.

    Terms are numbered over ranges; a document's cells meet in one row, as its text does. The terms that
    a document shares with no other one are one component, of their norm: all products of rows, and so distances
    and singular values, are those of all terms.
    """
    own = F.col("df") == 1
    names = document_index(weights.filter(~own).select("term").distinct(), "term").select("term", F.col("document_index").alias("at"))
    shared = names.count()
    alone = written(weights.filter(own).groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("weight"), F.count("*").alias("n")), "slice-own")
    terms = shared + (alone.agg(F.sum("n")).head()[0] or 0)
    placed = document_index(alone, "id").select("id", (F.col("document_index") + shared).alias("at"), "weight")
    cells = weights.filter(~own).join(names, "term").select("id", "at", "weight").unionByName(placed)
    met = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("cells"))
    listed = ids.select("id").join(met, "id", "left").select("id", F.coalesce("cells.at", F.array()).alias("at"), F.coalesce("cells.weight", F.array()).alias("x"))
    return written(stored_vectors(listed, "at"), "slice-vectors"), terms


def canonical_numbers(assigned: DataFrame, cluster: str = "cluster", member: str = "trace_id") -> DataFrame:
    """assigned with cluster_number: clusters in the order of their least member, which no two share."""
    least = assigned.groupBy(cluster).agg(F.min(member).alias("_least"))
    numbered = least.withColumn("cluster_number", F.row_number().over(Window.orderBy("_least")) - 1).drop("_least")
    return assigned.join(F.broadcast(numbered), cluster)


def distinct_vectors(weights: DataFrame) -> int:
    """How many different rows a corpus has, by a hash of each row's sorted terms and weights."""
    rows = weights.groupBy("id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("term", F.round("weight", 12).alias("w"))))), 256).alias("h"))
    return rows.select("h").distinct().count()
