"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. A null text counts
as empty, an empty table gives an empty one, and columns that are named like an operator's output
come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import exact_dedup, mixing, near_dup, packing, quality_classifier
from assayer.llm.common import small_batches, table, written
from assayer.llm.queries import vocabulary

#: Up to so many names of rows (some 80 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Names of the operators' outputs, which columns of documents may have too.
TAKEN = {"score", "predicted", "kept", "keep_id", "group_size", "size", "source_size", "target", "copies", "taken", "position", "positions"}


def aside(docs: DataFrame) -> DataFrame:
    """docs with columns of TAKEN names under names of their own."""
    small_batches(docs.sparkSession)
    return docs.withColumnsRenamed({c: f"_llm_in_{c}" for c in docs.columns if c in TAKEN})


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of aside(docs) with the columns of docs."""
    return rows.select(*[F.col(f"_llm_in_{c}").alias(c) if c in TAKEN else F.col(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, rejects go.

    Every row is judged by its text alone: rows that repeat share their fate, ids may be null. Without
    labels of both kinds all scores are alike.
    """
    scored = quality_classifier.classify(aside(docs), table(spark, sf_dir, "labels"))
    return back(scored.filter("predicted = 1"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; of rows that repeat it, one. Null ids are least."""
    return back(exact_dedup.exact_dedup(aside(docs)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the least id stays.

    One rule tells and orders rows: by id, nulls last, then by the text's sha256. Of rows that repeat
    id and text one stays. Texts without words all stay.
    """
    small_batches(spark)
    named = docs.withColumn("_llm_uid", row_name(F.col("doc_id"), F.col("text")))
    found = near_dup.near_dup(named.select("_llm_uid", "text"), k=5, id_col="_llm_uid")
    verdicts = written(found.filter("n_shingles > 0").select(F.col("doc_id").alias("_llm_uid"), "kept"), "near-verdicts")
    kept = _meeting(named, verdicts.filter("not kept").select("_llm_uid").distinct(), "left_anti")
    again = verdicts.filter("kept").groupBy("_llm_uid").count().filter("count > 1").select("_llm_uid")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = _meeting(kept, again, "left_semi").dropDuplicates(["_llm_uid"])
    return _meeting(kept, again, "left_anti").unionByName(once).select(*docs.columns)


def row_name(doc_id: Column, text: Column) -> Column:
    """A text that stands for a row and sorts as (id, nulls last, sha256 of the text) does."""
    number = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), number), F.lit("1")), F.sha2(F.coalesce(text, F.lit("")), 256))


def _meeting(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """docs joined with names (_llm_uid), which are broadcast where there are few."""
    held = written(names, "near-names")
    return docs.join(F.broadcast(held) if held.count() <= BROADCAST_IDS else held, "_llm_uid", how)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the order of training, over ranges of it.

    Rows that repeat are taken each; null sources are one more source, a null id one more id. A document
    without words is taken like any other, with 0 words.
    """
    return back(mixing.mix(aside(docs)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces, counted in token ids, with the sequences that hold them.

    Blocks are runs of rows as the mix left them, so a sequence holds one stretch of training. Rows
    that repeat, and rows without an id, are packed each.
    """
    small_batches(spark)
    return packing.best_fit(docs, tokenizer=vocabulary(), ordered=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier's training has no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
