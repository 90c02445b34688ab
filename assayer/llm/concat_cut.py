"""Packing by concatenation: all documents' ids in one line, cut into windows of a fixed length.

Two passes. The first encodes texts and stores each document's ids with its place in its partition.
The sums of the partitions, a row each, give by a prefix sum where every partition begins in the
whole line. The second pass reads the ids where they lie and cuts them: a window that one stretch of
rows fills is complete; what stands before the first cut and behind the last is a boundary record.
Records of one window, some ids each, meet by its number in a shuffle that carries nothing else.

So every window but the last is full, only a window's ids are held at a time besides a document's,
and the order of documents is that of their partitions: a document's pieces follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import blobs, lean, written
from assayer.llm.token_store import fits, groups_of_ids

#: Ids of a sequence, and the id that ends a document.
LENGTH, END_ID = 4096, 2
#: Sequences handed on together.
GROUP = 256
PIECE = "struct<at: int, doc_id: {kind}, start: bigint, length: bigint, doc_tokens: bigint>"


def placed(docs: DataFrame, tokenizer: str, dtype: str, end: int) -> DataFrame:
    """(doc_id, part, before, ids) of docs (doc_id, text): a partition's number, and the ids of its rows before."""
    fast, item = fits(tokenizer, dtype), np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for names, ids in groups_of_ids(batches, tokenizer, dtype, fast, end):
            ends = before + np.cumsum([len(b) // item for b in ids], dtype=np.int64)
            starts = np.concatenate([[before], ends[:-1]])
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, part int, before long, ids binary")


class _Cutter:
    """Windows of a stretch of the line: whole ones, and records of those that reach beyond it."""

    def __init__(self, length: int, item: int):
        self.length, self.item, self.at = length, item, None  # at: where the stretch ends so far
        self.ids, self.pieces, self.begin, self.out = [], [], 0, []

    def add(self, at: int, name: object, ids: bytes) -> None:
        n, done = len(ids) // self.item, 0
        if at != self.at:
            self.close()
            self.begin = at
        while done < n:
            take = min(n - done, self.length - (at + done) % self.length)
            self.ids.append(ids[done * self.item : (done + take) * self.item])
            self.pieces.append(((at + done) % self.length, name, done, take, n))
            done += take
            if (at + done) % self.length == 0:
                self.at = at + done
                self.close()
                self.begin = at + done
        self.at = at + n

    def close(self) -> None:
        if self.ids:
            joined = b"".join(self.ids)
            self.out.append((self.begin // self.length, self.begin % self.length, len(joined) == self.length * self.item, joined, self.pieces))
        self.ids, self.pieces = [], []


def cut(rows: DataFrame, length: int, dtype: str) -> DataFrame:
    """(sequence_id, at, whole, ids, pieces) of stored rows of placed(): complete windows and boundary records."""
    item = np.dtype(dtype).itemsize
    sums = dict(rows.groupBy("part").agg(F.sum(F.octet_length("ids") / item).cast("long")).collect())  # a row for each partition
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]
    sent = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, cutter, names_of = sent.value, _Cutter(length, item), None
        for batch in batches:
            names_of = batch.schema.field("doc_id").type
            for name, part, before, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), blobs(batch.column(3)), strict=True):
                cutter.add(begins[part] + before, name, ids)
                if len(cutter.out) >= GROUP:
                    yield _batch(cutter.out, names_of)
                    cutter.out = []
        cutter.close()
        if cutter.out:
            yield _batch(cutter.out, names_of)

    piece = PIECE.format(kind=rows.schema["doc_id"].dataType.simpleString())
    return rows.select("doc_id", "part", "before", "ids").mapInArrow(lean(run), f"sequence_id long, at int, whole boolean, ids binary, pieces array<{piece}>")


def _batch(windows: list[tuple], names_of: pa.DataType) -> pa.RecordBatch:
    number, at, whole, ids, pieces = zip(*windows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
    kinds = (pa.int32(), names_of, pa.int64(), pa.int64(), pa.int64())
    columns = [pa.array(list(x), k) for x, k in zip(zip(*[p for held in pieces for p in held], strict=True), kinds, strict=True)]
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["at", "doc_id", "start", "length", "doc_tokens"]))
    arrays = [pa.array(number, pa.int64()), pa.array(at, pa.int32()), pa.array(whole, pa.bool_()), pa.array(ids, pa.binary()), listed]
    return pa.RecordBatch.from_arrays(arrays, ["sequence_id", "at", "whole", "ids", "pieces"])


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END_ID, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): the whole table as windows of so many ids; the last may hold fewer.

    ids are little-endian numbers of the dtype. pieces tell, in order, which part of which document
    stands at which place: at, doc_id, start, length, doc_tokens (with the end id). A null or empty
    text has its end id alone. Every row is a document, so repeated rows, and rows without an id, stand
    in the line each. An empty table has no sequences. Documents stand as the partitions of docs do;
    sort docs by ranges before for another order.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = written(cut(written(placed(named, tokenizer, dtype, end), "placed-ids", "zstd"), length, dtype), "windows", "zstd")
    size = (F.octet_length("ids") / np.dtype(dtype).itemsize).cast("long").alias("n_tokens")
    whole = windows.filter("whole").select("sequence_id", size, "ids", "pieces")
    records = windows.filter("not whole").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "pieces"))).alias("r"))  # length ids at most
    joined = F.reduce("r.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")
    merged = records.select("sequence_id", joined, F.flatten("r.pieces").alias("pieces"))
    return whole.unionByName(merged.select("sequence_id", size, "ids", "pieces"))


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(2)
            flat = pieces.flatten()
            at, n = flat.field("at").to_pylist(), flat.field("length").to_pylist()
            counts = pieces.value_lengths().to_pylist()
            sums, k = [], 0
            for ids, many in zip(blobs(batch.column(1)), counts, strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                sums += [zlib.crc32(wide[4 * a : 4 * (a + m)]) for a, m in zip(at[k : k + many], n[k : k + many], strict=True)]
                k += many
            number = np.repeat(batch.column(0).to_numpy(), counts)
            columns = [flat.field("doc_id"), flat.field("start"), flat.field("length"), pa.array(sums, pa.int64()), flat.field("doc_tokens"), pa.array(number), flat.field("at").cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = sequences(docs, tokenizer).select("sequence_id", "ids", "pieces")
    return rows.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
