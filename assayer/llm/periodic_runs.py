"""Periodic runs of words, found by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q)
words that no neighbouring word extends. A text's distinct words are numbered, and each bit of the
numbers is a plane: one big integer with a bit for each word. For a lag p every plane is XORed with
itself shifted by p, and the results are ORed: a zero bit tells that words p apart are identical. A
run with period p shows as a stretch of zeros, p shorter than the run. Stretches that are long
enough are isolated by ANDs of the flipped bits with themselves, shifted by 1, 2, 4 and so on.

A stretch of a multiple of a run's period is the same words again, because three periods of a
stretch have room for both (Fine and Wilf): lags rise, and the first to show a stretch is its
smallest period.

Most lags end after a few planes, because no long stretch of zeros is left. In texts of over GATE
words lags are first looked at on every p-th word: the stretch of a run with period p has 2 * p
equal places at least, so two places side by side among those. No run is missed by it.

Texts are read whole, each by one task, without a shuffle; memory is that of a text's words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import blobs, lean

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Planes of a lag that are looked at before the rest.
FIRST = 3
#: Words of a text above which lags are looked at on every p-th word first.
GATE = 16_384
#: Bytes of texts after which results are handed on.
GROUP_BYTES = 1 << 20

Run = tuple[int, int, int]


def planes(numbers: np.ndarray) -> list[int]:
    """A big integer for each bit of the numbers; its bit i is that of word i.

    Numbers below 2^b are first multiplied by an odd constant modulo 2^b, which keeps them apart and
    spreads frequent words over all planes.
    """
    b = int(numbers.max()).bit_length() if len(numbers) else 0
    spread = numbers.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64((1 << b) - 1)
    return [int.from_bytes(np.packbits((spread >> np.uint64(k) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(b)]


def isolated(ones: int, length: int) -> int:
    """The starts of stretches of so many one bits, as bits: shift-doubling AND."""
    width = 1
    while ones and 2 * width <= length:
        ones &= ones >> width
        width *= 2
    return ones & ones >> (length - width) if ones and length > width else ones


def lags(numbers: np.ndarray) -> Iterator[int]:
    """The lags that a run can have, rising."""
    for p in range(1, len(numbers) // TIMES + 1):
        if len(numbers) > GATE:
            every = numbers[::p]
            same = every[1:] == every[:-1]
            if not (same[1:] & same[:-1]).any():
                continue
        yield p


def runs(words: Sequence[bytes]) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    bits, full, found = planes(numbers), (1 << n) - 1, {}
    first, rest = bits[:FIRST], bits[FIRST:]
    for p in lags(numbers):
        length = max(LEAST, TIMES * p) - p
        if length > n - p:
            continue
        within, unequal = full >> p, 0
        for plane in first:
            unequal |= plane ^ plane >> p
        starts = isolated(unequal & within ^ within, length)
        if starts and rest:
            for plane in rest:
                unequal |= plane ^ plane >> p
            starts = isolated(unequal & within ^ within, length)
        if starts:
            for a, b in _stretches(starts):
                found.setdefault((a, b + length - 1 + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _stretches(ones: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one bits."""
    raw = np.frombuffer(ones.to_bytes(ones.bit_length() // 8 + 1, "little"), np.uint8)
    edges = np.flatnonzero(np.diff(np.unpackbits(raw, bitorder="little"), prepend=0, append=0)).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def collapsed(words: Sequence[bytes], found: Sequence[Run]) -> bytes:
    """The words, joined by single spaces, without those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist()) if found else b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): every run of a text, by start, then period, and the text without its repetitions.

    Words stand between spaces and the control characters 9 to 13. A null or empty text has no
    words: no runs, and an empty text comes back. Every row is one text, whatever its id, so rows that
    repeat, and rows without an id, have a result each; an empty table gives an empty one. alter, where
    it is given, changes the words of a row (its id, its words) before.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            made: list[tuple[list[Run], bytes]] = []
            first, size = 0, 0
            for k, text in enumerate(blobs(batch.column(1))):
                words = text.split()
                if alter:
                    words = alter(names[k], words)
                found = runs(words)
                made.append((found, collapsed(words, found)))
                size += len(text)
                if size >= GROUP_BYTES or k == batch.num_rows - 1:
                    listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found, _ in made], kind)
                    texts = pa.array([t for _, t in made], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), listed, texts], ["doc_id", "runs", "collapsed"])
                    made, first, size = [], k + 1, 0

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def greatest(found: Column) -> Column:
    """Of an array of runs by start, then period, the first of those with the greatest exact length / period."""
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(found, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(longer(best, r), r).otherwise(best))


def planted(name: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's documents: those whose id's crc32 ends in 0 repeat a stretch from some word on; a null id's don't."""
    h = zlib.crc32(str(name).encode()) if name is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and sha256 of all runs and of what collapsing keeps."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = periodic_runs(docs.select("doc_id", "text"), alter=planted).withColumn("best", greatest(F.col("runs")))
    best = F.col("best")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Words of the same text and spelling, up to a third of the text apart, make the stretches; a CRC-32 goes bit by bit.
SQL = r"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)) AS h
  FROM documents),
shaped AS (SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM cut),
sized AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shaped),
altered AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM sized),
word AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM altered),
same AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 3),
stretch AS (
  SELECT doc_id, p, min(i) AS s, max(i) + 1 + p AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
run AS (SELECT doc_id, s, e - s AS l, min(p) AS p FROM stretch GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p)) AS runs_sha256 FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / p DESC, s, p) = 1),
left_over AS (
  SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = word.doc_id AND word.i >= r.s + r.p AND word.i < r.s + r.l) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, p AS period, (1000 * l) // p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
