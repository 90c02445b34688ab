"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step reads more of a text, and only of texts whose group at the step before has a second
member. Lengths and prefixes are compared in the JVM, where a scan's projection makes them; whole
texts are hashed, over Arrow, only where a prefix and length are found twice. Which groups have a
second member is told by a bitmap, whose size follows the number of groups up to a bound; a bit that two groups
share only lets a text through to the next step, it never joins texts.

Rows without a second member at the prefix step bypass every join. The groups of copies are
broadcast up to BROADCAST_GROUPS of them; beyond, the rows that may have a copy, and no others, meet
them in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import blobs, forget, lean, written

#: Code points of a prefix.
PREFIX = 256
#: A bitmap has 2 MB at least and 64 MB at most: what is broadcast at each step, whatever the input.
#: Beyond a million groups a byte of it hits falsely more often, which only makes more texts go on.
LEAST_BITS, MOST_BITS = 2**24, 2**29
#: What one row of a bitmap holds; a fixed value of Spark's bitmap functions.
CHUNK_BITS = 32768
#: Up to so many groups of copies are broadcast (48 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def _bitmap(keys: DataFrame, key: F.Column) -> DataFrame:
    """(_llm_chunk, _llm_bits): a bitmap with a bit for each key, at its hash modulo the bitmap's size.

    64 bits for each key, between LEAST_BITS and MOST_BITS; chunks of 4 KB are its rows.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * n).bit_length()))
    at = F.pmod(key, F.lit(bits)) + 1
    chunks = keys.select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_llm_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_llm_bits"))
    return written(chunks.withColumn("_llm_size", F.lit(bits)), "exact-bits")


def _among(docs: DataFrame, key: F.Column, chunks: DataFrame) -> DataFrame:
    """docs with _llm_hit: whether the bitmap has the key's bit. A null key has none."""
    head = chunks.select("_llm_size").head()
    at = F.pmod(key, F.lit(head[0] if head else LEAST_BITS))
    spot = docs.withColumn("_llm_at", at)
    near = spot.join(F.broadcast(chunks.drop("_llm_size")), F.floor(F.col("_llm_at") / CHUNK_BITS) + 1 == F.col("_llm_chunk"), "left")
    place = F.col("_llm_at") % CHUNK_BITS
    byte = F.conv(F.hex(F.substring("_llm_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")), F.lit(0)) == 1
    return near.withColumn("_llm_hit", hit).drop("_llm_at", "_llm_chunk", "_llm_bits")


def normal(blob: bytes) -> bytes:
    """bytes.lower() changes A-Z alone."""
    return blob.lower()


def _refined(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs with _llm_n and _llm_p: (those that may have a copy, all others), by length and prefix hash.

    Every row is in one of the two. Lengths and hashes of prefixes are made in the JVM; no text
    leaves the scan for it. Others has no row twice, whatever the bitmaps' false hits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    n = F.octet_length(text).cast("long")
    p = F.xxhash64(F.translate(F.substring(text, 1, PREFIX), *lower), n)
    lengths = written(docs.groupBy(n.alias("n")).count().filter("count > 1").select("n"), "exact-lengths")
    by_length = _bitmap(lengths, F.col("n"))
    sized = docs.withColumns({"_llm_n": n, "_llm_p": F.lit(None).cast("long")})
    again = _among(sized, F.col("_llm_n"), by_length).withColumn("_llm_p", F.when(F.col("_llm_hit"), p))
    starts = written(again.filter("_llm_hit").groupBy(F.col("_llm_p").alias("p")).count().filter("count > 1").select("p"), "exact-prefixes")
    told = _among(again.drop("_llm_hit"), F.col("_llm_p"), _bitmap(starts, F.col("p")))
    for used in (lengths, starts):
        forget(used)
    return told.filter("_llm_hit").drop("_llm_hit", "_llm_n", "_llm_p"), told.filter("not _llm_hit").drop("_llm_hit", "_llm_n", "_llm_p")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _llm_full, the SHA-256 of the normalised text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_llm_full", T.BinaryType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([hashlib.sha256(normal(b)).digest() for b in blobs(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [f.name for f in schema.fields])

    return docs.mapInArrow(lean(run), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept.

    Texts are equal when identical after A-Z are lower-cased; a null text counts as empty. keep_id
    is the largest id of the group (null ids are smaller than any), group_size its number of rows.
    kept is true for one row of each group: the row with keep_id, and of rows that repeat it the
    first by exact text. Columns of these names that docs has already are replaced.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    maybe, alone = _refined(docs, text_col)
    ids = _keyed(maybe.select(F.col(text_col).alias("t"), F.col(id_col).alias("i")), "t").groupBy(F.col("_llm_full").alias("_llm_k"), "i").count()
    last = F.max(F.struct("i", "count"))
    groups = ids.groupBy("_llm_k").agg(last["i"].alias("keep_id"), last["count"].alias("_llm_ties"), F.sum("count").alias("group_size")).filter("group_size > 1")
    groups = written(groups, "exact-groups")
    small = groups.count() <= BROADCAST_GROUPS
    joined = _keyed(maybe, text_col).join(F.broadcast(groups) if small else groups, F.col("_llm_full") == F.col("_llm_k"), "left")
    single = F.col("group_size").isNull()
    stays = single | F.col(id_col).eqNullSafe(F.col("keep_id"))
    if groups.filter("_llm_ties > 1").isEmpty():
        joined = joined.withColumn("kept", stays)
    else:  # rows repeat an id and text: the first by exact text stays; only such rows are shuffled
        tie = stays & (F.coalesce("_llm_ties", F.lit(1)) > 1)
        first = F.row_number().over(Window.partitionBy("_llm_k").orderBy(text_col)) == 1
        joined = joined.filter(~tie).withColumn("kept", stays).unionByName(joined.filter(tie).withColumn("kept", first))
    joined = joined.select(*docs.columns, F.when(single, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept")
    return joined.unionByName(alone.select(*docs.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [hashlib.sha256(normal(b)).hexdigest() for b in blobs(batch.column(batch.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """For each document: keep_id, group_size, kept, text_sha256 of the normalised text.

    Rows that repeat an id and text are returned each, and one of them is kept.
    """
    out = exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text")
    return out.mapInArrow(lean(_hashes), "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")


SQL = """
WITH t AS (
  SELECT doc_id, text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents
), g AS (
  SELECT doc_id, n, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
         row_number() OVER (PARTITION BY n ORDER BY doc_id DESC NULLS LAST, text NULLS FIRST) AS place FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(n) AS text_sha256
FROM g
"""
