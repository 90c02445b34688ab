"""Hard negatives of anchors, by product quantisation with stored residual norms.

Components become integers, so a score (an inner product) is exact. An index row holds a code for
each SPAN components (the nearest of CENTRES centres of integers), the norm of what the centres
leave over, and the components. For an anchor, the inner products with all centres make a lookup
table; the sum of a row's entries is its score to within |anchor| * residual norm (Cauchy-Schwarz).
So every row has a rigorous lower and upper bound of its score, and:

* of the rows with the anchor's label only those come to an exact score whose upper bound is no lower
  than the fifth greatest lower bound;
* a positive's window is a range of scores. Of the rows with other labels those come to an exact score
  whose bounds meet the window, and whose upper bound is no lower than the tenth greatest exact score
  found in the window so far, among the rows that the tables place highest in it first.

What is left is scored in integers, so the result is that of comparing with every row: recall is 1.

Anchors are a stated query set. They are dealt to blocks of about BLOCK; each block is broadcast
(its size is bounded) and the index scanned for it twice, without moving the index. A task hands on
a list's length of rows an anchor and window at most, and a ranking that Spark prunes before its
shuffle merges those. Centres are fitted to SAMPLE rows or so; they decide how much is pruned, and no
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import lean, written

#: Components become floor(SCALE * x).
SCALE = 256
#: Components that share a code, centres of a code, rows that the centres are fitted to, and rounds of fitting.
SPAN, CENTRES, SAMPLE, ROUNDS = 2, 256, 8192, 6
#: Anchors of a block, which each executor holds; anchors whose lookup tables a task holds; rows of a group.
BLOCK, TABLES, GROUP = 4096, 128, 8192
#: Times a list's length of rows that are scored first, to raise the floor of a window.
PROBES = 4
#: No bound on a score: below all scores, and above them.
LOW, HIGH = -(2**62), 2**62


def whole(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their components as integers, zeros behind shorter ones) of an Arrow list column."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().cast(pa.float64())
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(values.is_valid())
    good[rows[bad]] = False
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.float64)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.where(bad, 0, flat.fill_null(0).to_numpy(zero_copy_only=False))
    places = np.flatnonzero(good)
    return places, np.floor(SCALE * out[places])


@dataclass
class Codebook:
    """centres: (codes of a row, CENTRES, SPAN) whole numbers."""

    centres: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[0] * SPAN

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms, rounded up) of rows of whole numbers."""
        codes, left = np.zeros((len(v), len(self.centres)), np.uint8), np.zeros(len(v))
        for m, centres in enumerate(self.centres):
            part = v[:, m * SPAN : (m + 1) * SPAN]
            nearest = np.argmin((centres**2).sum(1) - 2 * (part @ centres.T), axis=1)
            codes[:, m] = nearest
            left += ((part - centres[nearest]) ** 2).sum(1)
        return codes, up(left)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(codes of a row, anchors, CENTRES): inner products of all centres with the anchors' parts."""
        parts = anchors.reshape(len(anchors), len(self.centres), SPAN)
        return np.ascontiguousarray(np.einsum("mcs,ams->mac", self.centres, parts.astype(np.float64))).astype(np.int64)


def up(squares: np.ndarray) -> np.ndarray:
    """Square roots, rounded up to whole numbers: bounds with them hold in integers."""
    return np.ceil(np.sqrt(squares) * (1 + 2.0**-40)).astype(np.int64)


def fitted(v: np.ndarray, width: int) -> Codebook:
    """Centres of each SPAN components: some rounds of k-means from rows spread over the sample."""
    codes = max(1, -(-width // SPAN))
    padded = np.zeros((max(len(v), 1), codes * SPAN))
    padded[: len(v), : v.shape[1]] = v
    out = np.zeros((codes, CENTRES, SPAN))
    for m in range(codes):
        part = padded[:, m * SPAN : (m + 1) * SPAN]
        order = np.lexsort(part.T)
        centres = part[order[np.linspace(0, len(part) - 1, CENTRES).astype(int)]].astype(np.float64)
        for _ in range(ROUNDS):
            nearest = np.argmin((centres**2).sum(1) - 2 * (part @ centres.T), axis=1)
            n = np.bincount(nearest, minlength=CENTRES)
            sums = np.stack([np.bincount(nearest, part[:, s], CENTRES) for s in range(SPAN)], axis=1)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        out[m] = np.rint(centres)
    return Codebook(out)


def _exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products with an anchor; numbers of either kind hold them exactly (see exact_kind)."""
    return (rows @ anchor).astype(np.int64)


def exact_kind(norm: int) -> type[np.floating]:
    """The smaller kind of floating-point numbers that holds every sum of products of vectors up to a norm exactly.

    Sums of absolute products are norm * norm at most, so whole numbers below 2^24 or 2^53, in any order of adding.
    """
    return np.float32 if norm * norm < 2**24 else np.float64


class Best:
    """The first rows of each list, by falling score, then id; lists are numbered."""

    def __init__(self, lists: int, keep: int):
        self.keep = keep
        self.lists, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(lists, LOW, np.int64)  # a list's last score, once it is full

    def add_all(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """found: (lists, ids, scores) each."""
        of, names, s = (np.concatenate([held, *new]) for held, new in zip((self.lists, self.ids, self.scores), zip(*found, strict=True) if found else ((), (), ()), strict=True))
        order = np.lexsort((names, -s, of))
        of, names, s = of[order], names[order], s[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        rank = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
        full = of[rank == self.keep - 1]
        self.least[full] = s[rank == self.keep - 1]
        self.lists, self.ids, self.scores = (x[rank < self.keep] for x in (of, names, s))


@dataclass
class Anchors:
    """A block: ids, labels and components; windows (anchor, low, high) of scores, by anchor, for the second scan."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    windows: np.ndarray

    def scored(self, book: Codebook, which: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of the anchors of which (down) and of rows (across)."""
        tables = book.tables(self.v[which])
        total = np.zeros((len(which), len(codes)), np.int64)
        for m in range(codes.shape[1]):
            total += tables[m].take(codes[:, m], axis=1)
        slack = up((self.v[which].astype(np.float64) ** 2).sum(1))[:, None] * norms[None, :]
        return total - slack, total + slack


@dataclass
class Rows:
    """A group of rows of the index."""

    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    norms: np.ndarray
    v: np.ndarray


def _kth(values: np.ndarray, keep: int) -> int:
    """The keep-th greatest, LOW where there are fewer."""
    return int(np.partition(values, len(values) - keep)[len(values) - keep]) if len(values) >= keep else LOW


def _positives(anchors: Anchors, book: Codebook, keep: int, best: Best, rows: Rows) -> None:
    """Adds to best, a list an anchor, what a group of rows has of each anchor's label."""
    found = []
    for label in np.intersect1d(rows.labels, anchors.labels).tolist():
        at, mine = np.flatnonzero(rows.labels == label), np.flatnonzero(anchors.labels == label)
        for a in range(0, len(mine), TABLES):
            which = mine[a : a + TABLES]
            low, high = anchors.scored(book, which, rows.codes[at], rows.norms[at])
            for k, lo, hi in zip(which.tolist(), low, high, strict=True):
                own = rows.ids[at] == anchors.ids[k]
                lo[own], hi[own] = LOW, LOW
                kept = at[(hi >= max(_kth(lo, keep), int(best.least[k]))) & ~own]
                found.append((np.full(len(kept), k), rows.ids[kept], _exact(rows.v[kept], anchors.v[k])))
    best.add_all(found)


def _negatives(anchors: Anchors, book: Codebook, keep: int, best: Best, rows: Rows) -> None:
    """Adds to best, a list a window, what a group of rows has of other labels within it."""
    mine, first = np.unique(anchors.windows[:, 0], return_index=True)
    ends = np.append(first[1:], len(anchors.windows))
    by_label = {label: np.flatnonzero(rows.labels == label) for label in np.intersect1d(rows.labels, anchors.labels[mine]).tolist()}
    nowhere, found = np.zeros(0, np.int64), []
    for a in range(0, len(mine), TABLES):
        which = mine[a : a + TABLES]
        low, high = anchors.scored(book, which, rows.codes, rows.norms)
        for i, anchor in enumerate(which.tolist()):
            lists = range(first[a + i], ends[a + i])
            same = by_label.get(anchors.labels[anchor], nowhere)
            low[i, same], high[i, same] = HIGH, LOW
            floors = [max(int(anchors.windows[k, 1]), int(best.least[k])) for k in lists]
            tops = [int(anchors.windows[k, 2]) for k in lists]
            near = np.flatnonzero((high[i] >= min(floors)) & (low[i] <= max(tops)))
            if not len(near):
                continue
            lo, hi, scores = low[i, near], high[i, near], np.full(len(near), HIGH)
            for j, k in enumerate(lists):  # a list's length of exact scores near the top of a window raises its floor
                likely = np.flatnonzero((hi >= floors[j]) & (lo + hi <= 2 * tops[j]))
                if len(likely) > PROBES * keep:
                    likely = likely[np.argpartition(lo[likely], len(likely) - PROBES * keep)[-PROBES * keep :]]
                    probed = _exact(rows.v[near[likely]], anchors.v[anchor])
                    floors[j] = max(floors[j], _kth(probed[(probed >= anchors.windows[k, 1]) & (probed <= tops[j])], keep))
            wanted = [(hi >= floor) & (lo <= top) for floor, top in zip(floors, tops, strict=True)]
            any_of = np.flatnonzero(np.logical_or.reduce(wanted))
            scores[any_of] = _exact(rows.v[near[any_of]], anchors.v[anchor])
            for k, floor, top in zip(lists, floors, tops, strict=True):
                fit = (scores >= floor) & (scores <= top)
                found.append((np.full(int(fit.sum()), k), rows.ids[near[fit]], scores[fit]))
    best.add_all(found)


class Index:
    """Vectors with codes and residual norms, stored once, scanned for blocks of anchors."""

    def __init__(self, rows: DataFrame, label: Column | None = None):
        """rows: (vec_id, embedding, label); label: what is taken for the label instead."""
        self.spark = rows.sparkSession
        wanted = rows.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
        wanted = wanted.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        n, width, norm = _measured(wanted)
        if 4 * norm * norm >= 2**53:  # scores and bounds of them stay exact in 64-bit numbers of either kind
            raise ValueError("components are too large for exact scores")
        self.kind = exact_kind(norm)
        self.book = fitted(_sampled(wanted, n, width), width)
        self.rows = written(_indexed(wanted, self.book), "vector-index")

    def blocks(self, chosen: Column) -> Iterator[Anchors]:
        """The rows of the condition in blocks of about BLOCK. Their order in a block is that of (vec_id, label, components)."""
        anchors = self.rows.filter(chosen).select("vec_id", "label", "v", F.xxhash64(F.monotonically_increasing_id()).alias("_deal"))
        n = anchors.count()
        parts = -(-n // BLOCK)
        dealt = anchors.withColumn("block", F.pmod("_deal", F.lit(max(1, parts))).cast("int")).drop("_deal")
        if parts > 1:
            dealt = written(dealt.repartition(parts, "block"), "anchors")
        for b in range(parts):
            got = dealt.filter(F.col("block") == b).toArrow()
            v = _unpacked(got["v"], self.book.width, self.kind)
            ids, labels = got["vec_id"].to_numpy(), got["label"].to_numpy()
            order = np.lexsort((*v.T[::-1], labels, ids))
            yield Anchors(ids[order], labels[order], v[order], np.zeros((0, 3), np.int64))

    def scan(self, anchors: Anchors, find, keep: int, lists: int) -> DataFrame:
        """(list, vec_id, score, rank): the first rows of each list by find, over the whole index."""
        sent = self.spark.sparkContext.broadcast((anchors, self.book))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, book = sent.value
            best, held, rows = Best(lists, keep), [], 0

            def flush() -> None:
                t = pa.Table.from_batches(held)
                codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(t), -1)
                v = _unpacked(t["v"], book.width, block.v.dtype)
                find(block, book, keep, best, Rows(t["vec_id"].to_numpy(), t["label"].to_numpy(), codes, t["norm"].to_numpy(), v))

            for batch in batches:
                for a in range(0, batch.num_rows, GROUP):
                    held.append(batch.slice(a, GROUP))
                    rows += held[-1].num_rows
                    if rows >= GROUP:
                        flush()
                        held, rows = [], 0
            if rows:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.lists, best.ids, best.scores)], ["list", "vec_id", "score"])

        found = self.rows.mapInArrow(lean(run), "list long, vec_id long, score long")
        order = Window.partitionBy("list").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _measured(rows: DataFrame) -> tuple[int, int, int]:
    """(usable rows, components of the longest, a whole number above the greatest norm) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width, norm = 0, 0, 0.0
        for batch in batches:
            places, v = whole(batch.column(0))
            n, width = n + len(places), max(width, v.shape[1])
            norm = max(norm, float(np.sqrt((v * v).sum(1)).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, width, norm)], ["n", "width", "norm"])

    got = rows.select("embedding").mapInArrow(lean(run), "n long, width long, norm double").agg(F.sum("n"), F.max("width"), F.max("norm")).head()
    return got[0] or 0, got[1] or 0, int(min(got[2] or 0, 2.0**62)) + 1


def _sampled(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """About SAMPLE usable vectors, twice that at most."""
    part = min(1.0, SAMPLE / max(1, n))
    got = rows.select("embedding").sample(part, seed=7).limit(2 * SAMPLE).toArrow()["embedding"].combine_chunks()
    v = whole(got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got)[1]
    return np.pad(v, ((0, 0), (0, max(0, width - v.shape[1]))))


def _indexed(rows: DataFrame, book: Codebook) -> DataFrame:
    """(vec_id, label, codes, norm, v): v has the components as 32-bit integers, or 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, got = whole(batch.column(2))
            v = np.zeros((len(places), book.width))
            v[:, : got.shape[1]] = got
            codes, norms = book.encode(v)
            kept = pa.array(places)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, v.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), packed[0], pa.array(norms), packed[1]], ["vec_id", "label", "codes", "norm", "v"])

    return rows.mapInArrow(lean(run), "vec_id long, label long, codes binary, norm long, v binary")


def _unpacked(v: pa.ChunkedArray, width: int, kind: type[np.floating]) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), "<i4").reshape(-1, width).astype(kind)


def hard_negatives(rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among rows (vec_id, embedding, label).

    An anchor's positives are its first rows of the same label, by falling score, then id, without
    rows of its own id. A positive's negatives are the first rows of other labels whose score is
    from low to high percent of the positive's. Rows with a null id, label or vector, or with a null
    or non-finite component, take no part. A shorter vector has zeros behind; an empty one scores 0 with
    all. Each row counts by itself: a repeated row may be positive or negative twice, and an anchor
    whose id repeats has a result for each row. Rows whose exact scores wouldn't fit are an error. No
    anchors, no positives or an empty window: no rows.
    """
    index, found = Index(rows, label), []
    for block in index.blocks(anchors):
        names = rows.sparkSession.createDataFrame(pa.table({"anchor": np.arange(len(block.ids)), "anchor_id": block.ids}))
        near = index.scan(block, _positives, positives, len(block.ids)).toArrow().sort_by([("list", "ascending"), ("rank", "ascending")])
        of, score = near["list"].to_numpy(), near["score"].to_numpy()
        block.windows = np.stack([of, -(-low * score // 100), high * score // 100], axis=1)
        block.windows[score < 0, 1:] = HIGH, LOW
        told = pa.table({"list": np.arange(len(of)), "anchor": of, "positive_id": near["vec_id"], "positive_score": near["score"]})
        windows = rows.sparkSession.createDataFrame(told)  # positives times BLOCK rows at most
        mined = index.scan(block, _negatives, negatives, len(of)).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        result = mined.join(F.broadcast(windows), "list").join(F.broadcast(names), "anchor")
        found.append(written(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives"))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = found[0] if found else rows.sparkSession.createDataFrame([], kinds)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """The hard negatives of every hundredth id; labels of ids that 7 divides are moved on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label)


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negative AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""
