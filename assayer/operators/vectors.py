"""K-means and the singular value decomposition over stored vectors, dense or sparse, in passes of one job each.

Vectors are rows (id, h, at, x): h is a hash of the id, x the components, at the places of these in
ascending order, or null where x has all. A pass reads all rows once by mapInArrow and hands on what
it has summed. Sums of components are whole numbers (each component times a power of two), and
distances are rounded before they are compared, so the result doesn't depend on how rows are
dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.ordering import document_index
from assayer.functions.shared import written


class ClusteringError(ValueError):
    """A corpus that can't be clustered as asked."""


#: Numbers of one kind (all centers, or all their sums) that a task holds: as many starts as keep to it are under way at once.
CELLS = 2**23
#: Products of a chunk of rows, numbers and rows of a packed block, centers of a group of starts, and parts that sums are added up in.
PRODUCTS, PACKED, ROWS, CENTERS, ADDERS = 2**18, 2**18, 2**11, 2**11, 24
#: Types of ids.
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Decimals of a distance that count.
DIGITS = 10
#: Extra directions of the decomposition, passes at least and at most, and the change of a singular value that is none.
OVERSAMPLES, LEAST_PASSES, MOST_PASSES, SETTLED = 10, 7, 300, 1e-12


def stored_vectors(rows: DataFrame, at: str | None = None) -> DataFrame:
    """(id, h, at, x) of rows (id, x) or (id, at, x)."""
    places = F.col(at).cast("array<int>") if at else F.lit(None).cast("array<int>")
    return rows.select("id", F.xxhash64("id").alias("h"), places.alias("at"), F.col("x").cast("array<double>").alias("x"))


@dataclass
class Block:
    """Some rows: x holds the components of all, those of a row from its start on, at their places."""

    ids: pa.Array
    h: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    x: np.ndarray
    width: int

    def __post_init__(self) -> None:
        self.rows = np.repeat(np.arange(len(self.h)), np.diff(self.starts))
        self.squares = np.bincount(self.rows, self.x * self.x, len(self.h)) if len(self.x) else np.zeros(len(self.h))

    def dense(self) -> np.ndarray | None:
        """The rows as a matrix where each has all components."""
        return self.x.reshape(len(self.h), self.width) if len(self.x) == len(self.h) * self.width and (np.diff(self.starts) == self.width).all() else None

    def times(self, m: np.ndarray) -> np.ndarray:
        """The product of the rows with a matrix (width, columns)."""
        if (full := self.dense()) is not None:
            return full @ m
        out = np.zeros((len(self.h), m.shape[1]))
        step = max(1, min(CELLS, PRODUCTS) // max(1, m.shape[1]))
        filled = np.flatnonzero(np.diff(self.starts))
        first = 0
        while first < len(filled):  # as many whole rows as fit, one at least
            last = max(first + 1, int(np.searchsorted(self.starts[filled + 1], self.starts[filled[first]] + step, "right")))
            a, b = self.starts[filled[first]], self.starts[filled[last - 1] + 1]
            products = m.take(self.at[a:b], axis=0)
            products *= self.x[a:b, None]
            out[filled[first:last]] = np.add.reduceat(products, self.starts[filled[first:last]] - a, axis=0)
            first = last
        return out

    def summed(self, cells: np.ndarray, count: int, whole: np.ndarray, out: np.ndarray) -> None:
        """Adds whole, the components as whole numbers, to out (count, width, flat): those of a row to each of its cells (rows, cells)."""
        if self.dense() is None:
            for cell in cells.T:
                np.add.at(out, cell[self.rows] * self.width + self.at, whole)
            return
        marks = np.zeros((count, len(self.h)))
        marks[cells.reshape(-1), np.repeat(np.arange(len(self.h)), cells.shape[1])] = 1
        high = whole >> 26  # both halves' sums are exact in doubles
        halves = np.hstack([high.reshape(-1, self.width), (whole - (high << 26)).reshape(-1, self.width)]).astype(np.float64)
        added = (marks @ halves).astype(np.int64)
        out += ((added[:, : self.width] << 26) + added[:, self.width :]).reshape(-1)

    def only(self, lines: np.ndarray) -> Block:
        """The rows without the components whose line is -1, the others at their lines."""
        at = lines[self.at]
        found = at >= 0
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.rows[found], minlength=len(self.h)))]).astype(np.int64)
        return Block(self.ids, self.h, starts, at[found], self.x[found], self.width)

    def row(self, i: int) -> tuple[list[int], list[float]]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.at[a:b].tolist(), self.x[a:b].tolist()


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(3)
        starts = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = x.flatten().to_numpy(zero_copy_only=False)
        at = batch.column(2)
        if at.null_count:
            sizes = np.diff(starts)
            places = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
        else:
            places = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield Block(batch.column(0), batch.column(1).to_numpy(), starts, places, flat, width)


def packed(vectors: DataFrame) -> DataFrame:
    """(block): rows as Arrow streams of about PACKED numbers, which later passes take as they are, dealt to all cores however few files they come from."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.compute.sum(batch.column(3).value_lengths()).as_py() or 0
            step = min(ROWS, max(1, batch.num_rows * PACKED // max(1, cells)))
            for a in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, step)]) for c in batch.columns], schema=batch.schema))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return vectors.mapInArrow(over, "block binary").repartition(vectors.sparkSession.sparkContext.defaultParallelism)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def draws(h: np.ndarray, seed: int, start: int, step: int, trial: int) -> np.ndarray:
    """Exponential draws of rows, by their hashes alone: the row with the least draw / weight is one by weight."""
    salt = _mixed(np.array([(((seed * 1009 + start) * 65_537 + step) * 257 + trial) & (2**64 - 1)], np.uint64))
    bits = _mixed(h.astype(np.int64).view(np.uint64) ^ salt) >> np.uint64(11)
    return -np.log((bits.astype(np.float64) + 0.5) / 2.0**53)


def measured(vectors: DataFrame) -> tuple[int, int, float, float]:
    """(rows, width, greatest component, mean variance of a component). A component that isn't finite is an error."""
    size = F.when(F.size("x") > 0, F.coalesce(F.element_at("at", -1) + 1, F.size("x"))).otherwise(0)
    finite = F.forall("x", lambda v: F.abs(v) < float("inf"))  # nan is above infinity
    largest = F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    held = vectors.agg(F.count("*"), F.max(size), F.max(largest), F.sum(squares), F.count_if(~F.coalesce(finite, F.lit(False)))).head()
    n, width = held[0], held[1] or 0
    if held[4]:
        raise ClusteringError("a vector isn't finite")
    if not width:
        return n, 0, 0.0, 0.0
    means = vectors.select(F.posexplode("x"), "at").select(F.coalesce(F.get("at", F.col("pos")), "pos").alias("at"), "col").groupBy("at").agg((F.sum("col") / n).alias("m"))
    mean = means.agg(F.sum(F.col("m") * F.col("m"))).head()[0]
    return n, width, held[2], float(f"{max(0.0, (held[3] / n - mean) / width):.9g}")


#: Components that some centers have: their places, in ascending order, in a list of all components of all centers; and what they are.
Centers = tuple[np.ndarray, np.ndarray]


def _filled(x: np.ndarray) -> Centers:
    cells = np.flatnonzero(x)
    return cells, x[cells]


@dataclass
class Sent:
    """Centers on their way: the places of their components in a matrix (width, centers), the components, the centers' squares.

    kept: the components that any of the centers has, where the matrix has these alone.
    """

    place: np.ndarray
    x: np.ndarray
    squares: np.ndarray
    kept: np.ndarray | None = None


def _opened(sent: Sent, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(matrix, squares, the line of the matrix that a component has, or none) of centers."""
    lines = None
    if sent.kept is not None:
        lines = np.full(width, -1)
        lines[sent.kept] = np.arange(len(sent.kept))
    matrix = np.zeros((width if sent.kept is None else len(sent.kept), len(sent.squares)))
    matrix.reshape(-1)[sent.place] = sent.x
    return matrix, sent.squares, lines


class KMeans:
    """All starts of k-means: each pass serves every start under way, and a start that settles makes room for the next.

    Centers are lists of the components that they have: the driver holds and sends no more than these.
    """

    def __init__(self, vectors: DataFrame, k: int, starts: int = 20, iterations: int = 300, tolerance: float = 1e-4, seed: int = 42, width: int | None = None):
        self.vectors, self.k, self.starts, self.iterations, self.seed = vectors, k, starts, iterations, seed
        self.spark, self.passes, self.shared = vectors.sparkSession, 0, None
        self.n, found, largest, variance = measured(vectors)
        if not 1 <= k <= self.n:
            raise ClusteringError(f"{k} clusters of {self.n} vectors")
        self.width, self.largest = max(1, found), largest
        self.settled = tolerance * variance * self.width / max(self.width, width or 0)
        room = 62 - math.ceil(math.log2(self.n + 2))
        self.scale = 2.0 ** max(0, min(40, room - math.ceil(math.log2(largest + 1)) - 1))
        self.cost_scale = 2.0 ** max(0, min(30, room - 2 - math.ceil(math.log2(4 * largest * largest * self.width + 1))))
        self.trials = 2 + int(math.log(k))
        self.kind = vectors.schema["id"].dataType.simpleString()
        self.packed = self._packed(vectors).persist()

    def _packed(self, vectors: DataFrame) -> DataFrame:
        return packed(vectors)

    def _reader(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Block]]:
        """What reads packed rows in a task."""
        width = self.width
        return lambda batches: blocks(unpacked(batches), width)

    def _pass(self, run: Callable[[Block, dict[str, Any], Any], None], emit: Callable[[dict[str, Any]], Iterator[pa.RecordBatch]], ddl: str, sent: list[Sent | None]) -> DataFrame:
        """One scan: run adds a block to what a task holds, with the matrices of what is sent; emit makes its rows of that. What was sent before is dropped."""
        self.passes += 1
        width, read = self.width, self._reader()
        if self.shared is not None:
            self.shared.destroy()  # the pass before is done
        shared = self.shared = self.spark.sparkContext.broadcast(sent)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Any] = {}
            matrices = None
            for block in read(batches):
                matrices = matrices or [None if m is None else _opened(m, width) for m in shared.value]
                run(block, held, matrices)
            if held:
                yield from emit(held)

        return self.packed.mapInArrow(over, ddl)

    def _sent(self, centers: list[Centers], per: int) -> Sent:
        """Lists of per centers each, as tasks get them."""
        columns = len(centers) * per
        places = [(cells % self.width) * columns + (cells // self.width + i * per) for i, (cells, _) in enumerate(centers)]
        squares = [np.bincount(cells // self.width, x * x, per) for cells, x in centers]
        place = np.concatenate(places)
        return Sent(place.astype(np.int32) if columns * self.width < 2**31 else place, np.concatenate([x for _, x in centers]), np.concatenate(squares))

    # Seeds

    def _raced(self, centers: list[Centers] | None, tried: list[Centers] | None, group: list[int], step: int) -> tuple[np.ndarray, dict[tuple[int, int, int], Centers]]:
        """(totals, rows): what each start's distances add up to with each of its tried centers, and for each of
        those and each trial of the next step a row, drawn by its distance from the nearest center then."""
        seed, trials, ids_of, scale = self.seed, self.trials if step else 1, ARROW[self.kind], self.cost_scale
        races = step < self.k

        def run(block: Block, held: dict[str, Any], sent: Any) -> None:
            after = np.ones((len(block.h), len(group), 1))
            if sent:
                far = _distances(block, *sent[1]).reshape(len(block.h), len(group), -1)
                near = _distances(block, *sent[0]).reshape(len(block.h), len(group), -1).min(axis=2)[:, :, None] if sent[0] else far
                after = np.minimum(near, far)
            best = held.setdefault("best", {})
            held["total"] = held.get("total", 0) + np.rint(after * scale).astype(np.int64).sum(axis=0)
            for g, start in enumerate(group if races else []):
                drawn = [draws(block.h, seed, start, step, trial) for trial in range(trials)]
                for c in range(after.shape[2]):
                    for trial in range(trials):
                        with np.errstate(divide="ignore"):
                            key = drawn[trial] / after[:, g, c]
                        i = int(key.argmin())
                        mine = (float(key[i]), block.ids[i].as_py())
                        if math.isfinite(mine[0]) and ((g, c, trial) not in best or mine < best[g, c, trial][0]):
                            best[g, c, trial] = (mine, block.row(i))

        def emit(held: dict[str, Any]) -> Iterator[pa.RecordBatch]:
            best, total = held["best"], held["total"]
            blank = [None] * total.size
            places = [divmod(i, total.shape[1]) for i in range(total.size)]
            made = [
                pa.array([g for g, _ in places] + [k[0] for k in best], pa.int32()),
                pa.array([c for _, c in places] + [k[1] for k in best], pa.int32()),
                pa.array([-1] * total.size + [k[2] for k in best], pa.int32()),
                pa.array(total.reshape(-1).tolist() + [0] * len(best), pa.int64()),
                pa.array(blank + [v[0][0] for v in best.values()], pa.float64()),
                pa.array(blank + [v[0][1] for v in best.values()], ids_of),
                pa.array(blank + [v[1][0] for v in best.values()], pa.list_(pa.int32())),
                pa.array(blank + [v[1][1] for v in best.values()], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(made, ["g", "c", "trial", "total", "key", "id", "at", "x"])

        sent = [] if tried is None else [None if centers is None else self._sent(centers, 1), self._sent(tried, 1)]
        rows = self._pass(run, emit, f"g int, c int, trial int, total long, key double, id {self.kind}, at array<int>, x array<double>", sent)
        found = rows.groupBy("g", "c", "trial").agg(F.sum("total").alias("total"), F.min_by(F.struct("at", "x"), F.struct("key", "id")).alias("r")).collect()
        totals, out = np.zeros((len(group), 1 if tried is None else len(tried) // len(group)), np.int64), {}
        for r in found:
            if r["trial"] < 0:
                totals[r["g"], r["c"]] = r["total"]
            else:
                out[r["g"], r["c"], r["trial"]] = np.array(r["r"]["at"], np.int64), np.array(r["r"]["x"], np.float64)
        return totals, out

    def _seeded(self, group: list[int]) -> list[Centers]:
        """Of each start: greedy k-means++ seeds; of the trials of a step the one that leaves the least total, the first of equals."""
        _, found = self._raced(None, None, group, 0)
        chosen, centers = np.zeros(len(group), int), [[] for _ in group]
        for step in range(1, self.k + 1):
            trials = self.trials if step > 1 else 1
            if any((g, c, 0) not in found for g, c in enumerate(chosen.tolist())):
                raise ClusteringError(f"{self.k} clusters need as many distinct vectors")
            tried = [[found[g, c, t] for t in range(trials)] for g, c in enumerate(chosen.tolist())]
            if step == self.k and trials == 1:
                totals = np.zeros((len(group), 1), np.int64)
            else:
                totals, found = self._raced(sum(centers, []) or None, sum(tried, []), group, step)
            chosen = totals.argmin(axis=1)
            for g, c in enumerate(chosen.tolist()):
                centers[g].append(tried[g][c])
        return [(np.concatenate([at + j * self.width for j, (at, _) in enumerate(c)]), np.concatenate([x for _, x in c])) for c in centers]

    # Rounds

    def _round(self, centers: list[Centers]) -> tuple[list[Centers], np.ndarray, np.ndarray, dict[int, Centers]]:
        """(sums, sizes, costs, the row farthest from its center) of each start."""
        starts, k, width = len(centers), self.k, self.width
        scale, cost_scale, ids_of = self.scale, self.cost_scale, ARROW[self.kind]

        def run(block: Block, held: dict[str, Any], sent: Any) -> None:
            if not held:
                held |= {"sums": np.zeros(starts * k * width, np.int64), "sizes": np.zeros(starts * k, np.int64), "costs": np.zeros(starts, np.int64), "far": {}}
            away = _distances(block, *sent[0]).reshape(len(block.h), starts, k)
            labels = away.argmin(axis=2)
            least = np.take_along_axis(away, labels[:, :, None], axis=2)[:, :, 0]
            held["costs"] += np.rint(least * cost_scale).astype(np.int64).sum(axis=0)
            cells = labels + np.arange(starts) * k
            held["sizes"] += np.bincount(cells.reshape(-1), minlength=starts * k)
            block.summed(cells, starts * k, np.rint(block.x * scale).astype(np.int64), held["sums"])
            for s in range(starts):
                i = int(least[:, s].argmax())
                mine = (-float(least[i, s]), block.ids[i].as_py())
                if s not in held["far"] or mine < held["far"][s][0]:
                    held["far"][s] = (mine, block.row(i))

        def emit(held: dict[str, Any]) -> Iterator[pa.RecordBatch]:
            for part in range(0, starts * k * width, size):
                some = held["sums"][part : part + size]
                if len(cells := np.flatnonzero(some)):
                    yield _summed(part // size, cells, some[cells], ids_of)
            yield _summed(-1, np.arange(starts * k + starts), np.concatenate([held["sizes"], held["costs"]]), ids_of)
            for s, ((key, name), (at, x)) in held["far"].items():
                yield _summed(-2 - s, np.array([]), np.array([]), ids_of, key, name, at, x)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            far: dict[int, tuple] = {}
            for row in (r for batch in batches for r in zip(*batch.columns, strict=True)):
                part = row[0].as_py()
                if part < -1:
                    mine = (row[3].as_py(), row[4].as_py(), row[5].as_py(), row[6].as_py())
                    far[part] = min(far.get(part, mine), mine, key=lambda m: m[:2])
                else:
                    total = totals.setdefault(part, np.zeros(size if part >= 0 else starts * k + starts, np.int64))
                    total[np.frombuffer(row[1].as_buffer(), np.int32)] += np.frombuffer(row[2].as_buffer(), np.int64)
            for part, total in totals.items():
                cells = np.flatnonzero(total)
                yield _summed(part, cells, total[cells], ids_of)
            for part, mine in far.items():
                yield _summed(part, np.array([]), np.array([]), ids_of, *mine)

        size = max(1, -(-starts * k * width // ADDERS))
        ddl = f"part int, place binary, value binary, key double, id {self.kind}, at array<int>, x array<double>"
        found = self._pass(run, emit, ddl, [self._sent(centers, k)]).repartition("part").mapInArrow(added, ddl).toArrow()
        small, far, parts = np.zeros(starts * k + starts, np.int64), {}, {}
        for part, place, value, at, x in zip(*(found[c] for c in ("part", "place", "value", "at", "x")), strict=True):
            part = part.as_py()
            if part < -1:
                far[-2 - part] = np.array(at.as_py(), np.int64), np.array(x.as_py(), np.float64)
                continue
            place, value = np.frombuffer(place.as_buffer(), np.int32), np.frombuffer(value.as_buffer(), np.int64)
            if part >= 0:
                parts[part] = place.astype(np.int64) + part * size, value
            else:
                small[place] = value
        ordered = [parts[p] for p in sorted(parts)]
        cells, sums = (np.concatenate([p[i] for p in ordered] or [np.array([], np.int64)]) for i in range(2))
        cuts = np.searchsorted(cells, np.arange(starts + 1) * k * width)
        listed = [(cells[a:b] - s * k * width, sums[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return listed, small[: starts * k].reshape(starts, k), small[starts * k :], far

    def _moved(self, old: Centers, sums: Centers, sizes: np.ndarray, far: Centers, width: int) -> Centers:
        """A start's next centers: the means of its sums; the first center without rows moves to the farthest row, others stay for a round."""
        cells, total = sums
        made = cells, total / (self.scale * sizes[cells // width])
        if (empty := np.flatnonzero(sizes == 0)).size:
            stays = np.isin(old[0] // width, empty[1:])
            parts = [made, (far[0] + empty[0] * width, far[1]), (old[0][stays], old[1][stays])]
            cells, x = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = cells.argsort()
            made = cells[order], x[order]
        return made

    def _settled(self) -> tuple[int, int, Centers] | None:
        """(cost, start, centers) of the cheapest start that settles with no empty cluster, the first of equals."""
        room = max(1, min(CELLS // (self.k * self.width), CENTERS // self.k))
        seeds: list[tuple[int, Centers]] = []
        for a in range(0, self.starts, room):
            group = list(range(a, min(self.starts, a + room)))
            seeds += [(start, c if isinstance(c, tuple) else _filled(c.reshape(-1))) for start, c in zip(group, self._seeded(group), strict=True)]
        best, active, away = None, [], np.zeros(self.k * self.width)
        while seeds or active:
            while seeds and len(active) < room:
                active.append((*seeds.pop(0), 1))
            sums, sizes, costs, far = self._round([c for _, c, _ in active])
            held, active = active, []
            for s, (start, old, rounds) in enumerate(held):
                fresh = self._moved(old, sums[s], sizes[s], far[s], self.width)
                away[fresh[0]] = fresh[1]
                away[old[0]] -= old[1]
                if (away**2).sum() <= self.settled and (sizes[s] > 0).all():
                    best = min(best or (int(costs[s]), start, old), (int(costs[s]), start, old), key=lambda d: d[:2])
                elif rounds < self.iterations:
                    active.append((start, fresh, rounds + 1))
                away[fresh[0]] = away[old[0]] = 0
        return best

    def fit(self) -> tuple[DataFrame, float, np.ndarray]:
        """((id, cluster), cost, centers) of the cheapest start that settled, the first of equals."""
        best = self._settled()
        self.packed.unpersist()
        if not best:
            raise ClusteringError(f"no run found {self.k} clusters")
        cost, _, (cells, x) = best
        centers = np.zeros((self.k, self.width))
        centers.reshape(-1)[cells] = x
        width, shared = self.width, self.spark.sparkContext.broadcast(self._sent([(cells, x)], self.k))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix = None
            for block in blocks(batches, width):
                matrix = matrix or _opened(shared.value, width)
                label = _distances(block, *matrix).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(label, pa.int32())], ["id", "cluster"])

        return self.vectors.mapInArrow(assigned, f"id {self.kind}, cluster int"), cost / self.cost_scale, centers


def _summed(part: int, cells: np.ndarray, values: np.ndarray, kind: pa.DataType, key: float | None = None, name: Any = None, at: list[int] | None = None, x: list[float] | None = None) -> pa.RecordBatch:
    """A row of sums of a part of all cells, or of the row that is farthest from its center."""
    made = [pa.array([part], pa.int32()), pa.array([cells.astype(np.int32).tobytes()], pa.binary()), pa.array([values.astype(np.int64).tobytes()], pa.binary()), pa.array([key], pa.float64()), pa.array([name], kind), pa.array([at], pa.list_(pa.int32())), pa.array([x], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(made, ["part", "place", "value", "key", "id", "at", "x"])


def _distances(block: Block, columns: np.ndarray, squares: np.ndarray, lines: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of rows from centers, rounded."""
    products = (block if lines is None else block.only(lines)).times(columns)
    return np.maximum(np.round(block.squares[:, None] - 2 * products + squares, DIGITS), 0)


def distinct(vectors: DataFrame) -> int:
    """How many vectors differ in their components, rounded to twelve decimals."""
    rounded = F.transform("x", lambda v: F.round(v, 12) + F.lit(0.0))
    return vectors.select(F.xxhash64("at", rounded), F.hash("at", rounded)).distinct().count()


def kmeans(vectors: DataFrame, k: int, starts: int = 20, iterations: int = 300, seed: int = 42, width: int | None = None) -> tuple[DataFrame, float]:
    """((id, cluster), cost) of rows of stored_vectors(), which are read from memory or disk once a pass.

    width: how many components the vectors had before sparse_vectors() joined some, for the tolerance.
    """
    from assayer.operators.wide import WideKMeans

    held = vectors.persist()
    try:
        sparse, cells = held.agg(F.count("at") == F.count("*"), F.max(F.array_max("at")) + 1).head()
        km = (WideKMeans if sparse and starts * k * (cells or 0) > CELLS else KMeans)(held, k, starts, iterations, seed=seed, width=width)
        try:
            found, cost, _ = km.fit()
            return written(found, "clusters"), cost
        finally:
            km.packed.unpersist()
    finally:
        held.unpersist()


# --- the singular value decomposition --------------------------------------------------------------------


def _times_transposed(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X' X q, summed over all packed rows; the driver and each task hold width x columns numbers."""
    width, columns = q.shape
    shared = rows.sparkSession.sparkContext.broadcast(q)
    size = max(1, -(-width // ADDERS))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns))
        for block in blocks(unpacked(batches), width):
            y = block.times(shared.value)
            if (full := block.dense()) is not None:
                total += full.T @ y
            else:
                for a in range(0, len(block.at), max(1, CELLS // columns)):
                    part = slice(a, a + max(1, CELLS // columns))
                    for j in range(columns):
                        total[:, j] += np.bincount(block.at[part], block.x[part] * y[block.rows[part], j], width)
        for part in range(0, width, size):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total[part : part + size].tobytes()], pa.binary())], ["part", "z"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for part, z in ((r[0].as_py(), np.frombuffer(r[1].as_buffer())) for batch in batches for r in zip(*batch.columns, strict=True)):
            totals[part] = totals[part] + z if part in totals else z
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "z"])

    found = rows.mapInArrow(over, "part long, z binary").repartition("part").mapInArrow(added, "part long, z binary").toArrow()
    shared.destroy()
    out = np.zeros((width, columns))
    for part, z in zip(found["part"], found["z"], strict=True):
        out[part.as_py() : part.as_py() + size] = np.frombuffer(z.as_buffer()).reshape(-1, columns)
    return out


def _triangle(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """R of the tall matrix X q: each task's rows are reduced to a triangle, and the triangles in turn, twice."""
    width, columns = q.shape
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def reduced(parts: Iterator[np.ndarray]) -> pa.RecordBatch:
        r = np.zeros((0, columns))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield reduced(block.times(shared.value) for block in blocks(unpacked(batches), width))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield reduced(np.frombuffer(r, np.float64).reshape(-1, columns) for batch in batches for r in batch.column(0).to_pylist())

    few = rows.mapInArrow(first, "r binary").repartition(8).mapInArrow(again, "r binary").collect()
    return np.linalg.qr(np.vstack([np.frombuffer(r["r"], np.float64).reshape(-1, columns) for r in few]), mode="r")


def _ranged(rows: DataFrame, q: np.ndarray, components: int) -> np.ndarray:
    """Orthogonal directions that hold the first components, from random ones.

    A pass multiplies the directions' residuals by X' X; the best directions among the old ones, the
    residuals and the last step go on. LEAST_PASSES are made at least, and on until no wanted singular
    value changes twice in a row.
    """
    aq, p, ap, quiet, before = _times_transposed(rows, q), None, None, 0, np.zeros(components)
    for i in range(MOST_PASSES):
        squares, turned = np.linalg.eigh(q.T @ aq)
        turned = turned[:, ::-1]
        q, aq, squares = q @ turned, aq @ turned, squares[::-1]
        now = np.sqrt(np.maximum(squares[:components], 0))
        quiet = quiet + 1 if np.abs(now - before).max() <= SETTLED * max(now.max(), 1e-300) else 0
        if i + 1 >= LEAST_PASSES and quiet > 1:
            break
        before = now
        w = aq - q * squares
        held = [q] if p is None else [q, p]  # lists of directions, never joined: memory is a few of them
        for _ in range(2):
            for u in held:
                w -= u @ (u.T @ w)
        w, r = np.linalg.qr(w)
        w = w[:, np.abs(np.diag(r)) > 1e-13 * max(np.abs(r).max(), squares[0], 1e-300)]
        for _ in range(2):
            for u in held:
                w -= u @ (u.T @ w)
        if not w.shape[1]:
            break  # nothing is left outside of the directions
        w = np.linalg.qr(w)[0]
        held, products = [*held, w], [aq, *([] if p is None else [ap]), _times_transposed(rows, w)]
        small = np.block([[u.T @ z for z in products] for u in held])
        _, best = np.linalg.eigh((small + small.T) / 2)
        best = best[:, ::-1][:, : q.shape[1]]
        cuts = np.split(best, np.cumsum([u.shape[1] for u in held])[:-1])
        step, moved = (sum(u @ c for u, c in zip(listed[1:], cuts[1:], strict=True)) for listed in (held, products))
        q, aq = q @ cuts[0], aq @ cuts[0]
        q += step
        aq += moved
        del held, products, w
        inside = q.T @ step  # the last step, made orthogonal to the new directions
        step -= q @ inside
        moved -= aq @ inside
        p, r = np.linalg.qr(step)
        kept = np.abs(np.diag(r)) > 1e-10
        if kept.all():
            ap = np.linalg.solve(r.T, moved.T).T
        else:
            p = ap = None
    return q


def _turned(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row (id, h, at, x) for each component, (id, h, row)): the transposed matrix, and the place of each vector in it."""
    placed = document_index(vectors.select("id", "h"), "id").select("id", "h", F.col("document_index").cast("int").alias("row"))
    cells = vectors.select("id", "at", F.posexplode("x")).select("id", F.coalesce(F.get("at", F.col("pos")), "pos").alias("place"), F.col("col").alias("x"))
    met = cells.join(placed.select("id", "row"), "id").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("row", "x"))).alias("c"))
    return met.select(F.col("place").alias("id"), F.lit(0).cast("long").alias("h"), F.col("c.row").alias("at"), F.col("c.x").alias("x")), placed


def decomposed(vectors: DataFrame, width: int, components: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """((id, h, at, x), singular values): rows by their first components, of norm 1 or 0.

    A random range finder (_ranged) with OVERSAMPLES more directions than components, then the triangle
    of the rows in these directions, whose singular values are those of the rows. Directions are lists of
    as many numbers as there are rows or components, whichever are fewer: where these are the rows, the
    transposed matrix is taken, whose directions are the rows' own values.
    """
    n = vectors.count()
    if not 1 <= components < min(width, n):
        raise ClusteringError(f"components must be from 1 to {min(width, n) - 1}")
    rows, placed, size = (*_turned(vectors), n) if n < width else (vectors, None, width)
    held = packed(rows).persist()
    try:
        directions = min(components + OVERSAMPLES, size)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, directions)))[0]
        q = _ranged(held, q, components)
        _, values, right = np.linalg.svd(_triangle(held, q))
        turned = right[:components].T
        turned *= np.where(turned[np.abs(turned).argmax(axis=0), np.arange(components)] < 0, -1, 1)
        found = q @ turned
        del q
        if placed is not None:
            found *= values[:components]
        shared, kind = vectors.sparkSession.sparkContext.broadcast(found), vectors.schema["id"].dataType.simpleString()

        def unit(ids: pa.Array, h: pa.Array, y: np.ndarray) -> pa.RecordBatch:
            norm = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-12)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * components, pa.int32()), pa.array(y.reshape(-1)))
            return pa.RecordBatch.from_arrays([ids, h, pa.nulls(len(y), pa.list_(pa.int32())), listed], ["id", "h", "at", "x"])

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, width):
                yield unit(block.ids, pa.array(block.h), block.times(shared.value))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield unit(batch.column(0), batch.column(1), shared.value[batch.column(2).to_numpy()])

        made = vectors.mapInArrow(project, f"id {kind}, h long, at array<int>, x array<double>") if placed is None else placed.mapInArrow(look_up, f"id {kind}, h long, at array<int>, x array<double>")
        return written(made, "components"), values[:components]
    finally:
        held.unpersist()
