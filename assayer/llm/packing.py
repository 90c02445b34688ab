"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest sequence (all tokens stay). Pieces are
dealt by a hash to blocks. A sequence costs what a model spends on it: OVERHEAD, its length, and
the square of its length over ATTENTION. So neither the longest length nor the shortest one is
always cheapest, and the permitted lengths are chosen jointly, for the block as a whole:

* for every set of lengths that may be opened (all subsets that hold the longest piece), the block
  is packed best-fit, longest piece first: a piece goes into the open sequence that leaves the least
  room; where none has room, the length of the set is opened that costs least per token of what the
  pieces still to come can fill it with;
* each sequence shrinks to the shortest permitted length that holds its contents;
* the set with the least total cost is taken. Each single length is one of the sets, so the result
  never costs more than the best single length with shrinking.

A block holds BLOCK pieces at most, however many rows share a key, so memory is bounded; only ids
and lengths travel.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lean, words
from assayer.llm.token_store import counted, counts_of_ids, fits

#: Token ids while they are counted, and the columns of packed pieces besides their document's id.
DTYPE, PACKED = "<u2", "piece int, start long, n_tokens long, sequence_id string, position long, capacity long"
#: Permitted lengths of a sequence, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 32
#: The length at which attention, which grows with the square, costs as much as all else.
ATTENTION = 4096
#: Pieces packed together. The waste of a block is about a sequence, so larger gains nothing.
BLOCK = 8192
#: Pieces that are looked for to tell how full a new sequence can become.
FILLS = 8


def cost(capacity: int) -> float:
    """What a sequence of a permitted length costs."""
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def _fill(order: Sequence[int], lone: Sequence[int], k: int, room: int) -> int:
    """How much of room the pieces behind k can fill, the longest that fits first."""
    filled, at = 0, k + 1
    for _ in range(FILLS):
        at = max(at, bisect.bisect_left(lone, filled - room))
        if at >= len(order):
            break
        filled -= lone[at]
        at += 1
    return filled


def _pack(order: Sequence[int], lone: Sequence[int], caps: Sequence[int], price: dict[int, float]) -> tuple[list[int], list[int], list[int]]:
    """For each piece of order (lengths descending, lone their negatives) its bin and offset, and how full each bin is."""
    bins, offsets, filled = [0] * len(order), [0] * len(order), []
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    for k, n in enumerate(order):
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b = len(filled)
            fitting = [cap for cap in caps if cap >= n]
            room = min(fitting, key=lambda cap: price[cap] / (n + _fill(order, lone, k, cap - n))) if len(fitting) > 1 else fitting[0]
            filled.append(0)
        bins[k], offsets[k] = b, filled[b]
        filled[b] += n
        if room > n:
            bisect.insort(rooms, (room - n, b))
    return bins, offsets, filled


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, price=cost) -> tuple[list[int], list[int], list[int]]:
    """For each length its bin, its offset there and the bin's length. Every length must fit the largest capacity.

    price gives what a sequence of a capacity costs, and must grow with it.
    """
    if not len(lengths):
        return [], [], []
    caps = sorted(set(capacities))
    prices = {c: price(c) for c in caps}
    places = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    order = [lengths[i] for i in places]
    lone, best = [-n for n in order], None
    for chosen in (c for size in range(1, len(caps) + 1) for c in itertools.combinations(caps, size) if c[-1] >= order[0]):
        made = _pack(order, lone, chosen, prices)
        least = [caps[bisect.bisect_left(caps, n)] for n in made[2]]
        total = sum(prices[c] for c in least)
        if best is None or total < best[0]:
            best = (total, made, least)
    _, (bins, offsets, _), least = best
    out = [0] * len(order), [0] * len(order), [0] * len(order)
    for k, i in enumerate(places):
        out[0][i], out[1][i], out[2][i] = bins[k], offsets[k], least[bins[k]]
    return out


def lengths_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n): the ids that the token store writes for a text, or its words where no tokenizer is named, and the end token."""
    if tokenizer is None:
        return docs.select(F.col(id_col).alias("doc_id"), (F.size(words(F.col(text_col))) + 1).cast("long").alias("n"))
    return counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = CAPACITIES[-1], tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens): a document's tokens and one end token, cut at ``longest``.

    A null or empty text has its end token alone.
    """
    cut = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / longest).cast("int"))).alias("piece")
    rows = lengths_of(docs, id_col, text_col, tokenizer).select("doc_id", "n", cut)
    start = (F.col("piece") * F.lit(longest)).cast("long")
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - start).alias("n_tokens"))


def _packer(caps: tuple[int, ...], block: int = BLOCK):
    """A function over batches of pieces and their _llm_part, block by block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, number, dealt_part = 0, 0, None

        def flush(upto: pa.Table) -> pa.RecordBatch:
            nonlocal number
            bins, offsets, caps_of = pack(upto["n_tokens"].to_pylist(), caps)
            parts_of = upto["_llm_part"].to_pylist()
            names = [f"{p}-{number}-{b}" for p, b in zip(parts_of, bins, strict=True)]
            number += 1
            out = upto.drop_columns(["_llm_part"]).combine_chunks()
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(caps_of, pa.int64())], [*out.column_names, "sequence_id", "position", "capacity"])

        for batch in batches:
            # parts of a hash may share a partition: a block never spans two of them
            ids = batch.column(batch.schema.get_field_index("_llm_part")).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and ids[a] != dealt_part:
                    yield flush(pa.Table.from_batches(held))
                    held, count, number = [], 0, 0
                elif ids[a] != dealt_part:
                    number = 0
                dealt_part = ids[a]
                while a < b:
                    take = min(b - a, block - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == block:
                        yield flush(pa.Table.from_batches(held))
                        held, count = [], 0
        if held:
            yield flush(pa.Table.from_batches(held))

    return packed


def _cut(batches: Iterator[pa.RecordBatch], longest: int, part: int) -> Iterator[pa.RecordBatch]:
    """The rows of pieces(), with their _llm_part, of batches (doc_id, n)."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        times = (n - 1) // longest + 1
        rows = np.repeat(np.arange(len(n)), times)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        start = piece * longest
        arrays = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start), pa.array(np.minimum(longest, n[rows] - start)), pa.array(np.full(len(rows), part, np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "n_tokens", "_llm_part"])


def pack_pieces(rows: DataFrame, capacities: Sequence[int] = CAPACITIES, block: int = BLOCK, ordered: bool = False) -> DataFrame:
    """rows of pieces() with sequence_id, position in the sequence, and the sequence's length.

    sequence_id is <partition>-<block>-<bin>. Pieces are dealt by a hash of id and piece and sorted
    within a partition, so that reruns with as many partitions agree. Where the order of rows is that
    of training (ordered), blocks are runs of rows as they stand, without a shuffle: a sequence
    holds pieces of one stretch of training, and copies of a document that stand apart stay apart.
    """
    caps, parts = tuple(capacities), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id() if ordered else F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    dealt = rows.withColumn("_llm_part", part)
    if not ordered:
        dealt = dealt.repartition(parts, "_llm_part").sortWithinPartitions("_llm_part", F.xxhash64("doc_id", "piece"), "doc_id", "piece", "n_tokens")

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.select("doc_id", "piece", "start", "n_tokens", "_llm_part").mapInArrow(lean(_packer(caps, block)), f"doc_id {kind}, {PACKED}")


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, tokenizer: str | None = None, ordered: bool = False) -> DataFrame:
    """Packs whole texts, counted in ids of a tokenizer file (or words) and one end token each.

    Rows that repeat, and rows without an id, are packed each; a null text has its end token alone.
    Where texts are encoded and packed as they stand, one Python worker does both.
    """
    if tokenizer is not None and ordered:
        fast, caps = fits(tokenizer, DTYPE), tuple(capacities)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            yield from _packer(caps)(_cut(counts_of_ids(batches, tokenizer, DTYPE, fast), max(caps), part))

        kind = docs.schema[id_col].dataType.simpleString()
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, {PACKED}")
    return pack_pieces(pieces(docs, id_col, text_col, max(capacities), tokenizer), capacities, ordered=ordered)


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return best_fit(docs.select("doc_id", "text"), tokenizer=tokenizer)
