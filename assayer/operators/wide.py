"""K-means over sparse vectors whose centers have too many components to be sent for all starts at once.

Most components are rare: few rows have them. Centers travel as the components that many rows have, and as
the labels of all rows. What a center has of a rare component, each task sums itself, in whole numbers,
from the labels of the rows that share it: these are stored beside the task's own rows once. Slices and
costs are those of KMeans.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.ordering import document_index
from assayer.operators import vectors as V
from assayer.operators.vectors import ARROW, Block, Centers, KMeans, Sent, _distances, _filled, _summed

#: Rows that a rare component has at most, and numbers of a part's rows, about.
RARE, PART = 2**8, 2**19
#: Products that a common component of a center costs, for each core.
COMMON = 16
#: Bits of the lower half of a whole number where squares are summed exactly, and products whose sum is a whole number of 64 bits.
HALF, EXACT = 26, 2**10


@dataclass
class Part:
    """Rows of one task, by place: components are numbered within the part. Those of rare ones with all rows that share them."""

    first: int
    ids: pa.Array
    h: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    x: np.ndarray
    cols: np.ndarray  # the components of the part, ascending
    common: np.ndarray  # of those that many rows have: the number within the part ...
    common_at: np.ndarray  # ... and among all common ones
    shared: np.ndarray  # a rare component's number, for each row that has it ...
    places: np.ndarray  # ... the row's place among all rows ...
    whole: np.ndarray  # ... and its component as a whole number
    own: np.ndarray  # whether this part counts the component in sums over all

    def block(self) -> Block:
        return Block(self.ids, self.h, self.starts, self.at, self.x, len(self.cols))

    def everywhere(self, width: int) -> Block:
        """The rows with components as they are numbered in all vectors."""
        return Block(self.ids, self.h, self.starts, self.cols[self.at], self.x, width)


@dataclass
class Start:
    """The centers of a start: means of the rows with a label, or (explicit) lists of components."""

    common: Centers  # of components that many rows have
    explicit: dict[int, Centers] = field(default_factory=dict)  # rare components of centers that aren't the means of labels
    labels: np.ndarray | None = None
    sizes: np.ndarray | None = None
    squares: np.ndarray | None = None

    def rare(self, part: Part, k: int, scale: float) -> np.ndarray:
        """(components of the part, k): what the centers have of rare components."""
        m = np.zeros((len(part.cols), k))
        if self.labels is not None:
            sums = np.bincount(part.shared * k + self.labels[part.places], part.whole, len(part.cols) * k)  # exact: see _limit
            m = sums.reshape(-1, k) / (scale * np.maximum(self.sizes, 1))
        for c, (at, x) in self.explicit.items():
            line = np.minimum(np.searchsorted(part.cols, at), len(part.cols) - 1)
            here = part.cols[line] == at if len(part.cols) else np.zeros(len(at), bool)
            m[:, c] = 0
            m[line[here], c] = x[here]
        return m


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for data in batch.column(0):
            yield pickle.loads(data.as_buffer())


class WideKMeans(KMeans):
    """KMeans, but that a pass takes as many starts as keep to CELLS by their common components alone."""

    def _packed(self, vectors: DataFrame) -> DataFrame:
        """(part): rows dealt by their place in the order of ids, each part with the rows elsewhere that share its rare components."""
        n, scale = self.n, self.scale
        numbers = vectors.agg(F.sum(F.size("x"))).head()[0] or 0
        cores = self.spark.sparkContext.defaultParallelism
        self.worth = COMMON * cores
        self.parts = count = cores * max(1, -(-numbers // (PART * cores)))
        placed = document_index(vectors.select("id", "h", "at", "x"), "id").withColumnRenamed("document_index", "place")
        placed = placed.withColumn("part", F.expr(f"cast(place * {count} div {n} as int)"))
        counts = placed.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("rows")).persist()
        limit = self._limit({r["rows"]: r["n"] for r in counts.groupBy("rows").agg(F.count("*").alias("n")).collect()})
        common_rows = counts.filter(F.col("rows") > limit).select("at")
        self.common = common = np.sort(common_rows.toArrow()["at"].to_numpy().astype(np.int64))
        cells = placed.select("place", "part", F.explode(F.arrays_zip("at", "x")).alias("c")).select("place", "part", "c.at", "c.x")
        held = cells.join(F.broadcast(common_rows), "at", "left_anti").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("place", "x", "part"))).alias("r"))
        met = held.select(F.explode(F.array_distinct("r.part")).alias("part"), F.col("at").alias("col"), F.col("r.place").alias("places"), F.col("r.x").alias("x"), F.get("r.part", F.lit(0)).alias("owner"))
        rows = placed.select("part", F.lit(-1).alias("col"), F.col("place").alias("row"), "id", "h", "at", "x")
        both = rows.unionByName(met, allowMissingColumns=True).repartitionById(count, "part").sortWithinPartitions("col", "row")

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            table = pa.Table.from_batches(batches).combine_chunks()
            own = int((table["col"].to_numpy() < 0).sum())
            if not own:
                return
            mine, others = table.slice(0, own), table.slice(own)
            here = mine["part"][0].as_py()
            if here != mine["part"][own - 1].as_py():
                raise ValueError("parts were dealt to one partition")

            def listed(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
                c = pa.concat_arrays(t[name].chunks or [pa.array([], t.schema.field(name).type)])
                return c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False)

            x, sizes = listed(mine, "x")
            at, _ = listed(mine, "at")
            cols, local = np.unique(at, return_inverse=True)
            seen = np.isin(cols, common)
            values, lengths = listed(others, "x")
            shared = np.searchsorted(cols, others["col"].to_numpy())
            made = Part(
                mine["row"][0].as_py(), pa.concat_arrays(mine["id"].chunks), mine["h"].to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), local.astype(np.int64), x, cols.astype(np.int64),
                np.flatnonzero(seen).astype(np.int32), np.searchsorted(common, cols[seen]), np.repeat(shared, lengths), listed(others, "places")[0].astype(np.int32 if n < 2**31 else np.int64), np.rint(values * scale), np.repeat(others["owner"].to_numpy() == here, lengths),
            )
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], ["part"])

        self.counts = counts
        return both.mapInArrow(over, "part binary")

    def _limit(self, found: dict[int, int]) -> int:
        """How many rows a rare component has at most: what costs least, with room for all starts where RARE allows that.

        A common component costs the driver and each part; a rare one costs each part that has it as
        many products as it has rows. Sums of so many whole numbers are exact in doubles. found: components by the number of their rows.
        """
        most = min(RARE, int(2.0**52 / max(1.0, self.scale * self.largest)))
        beyond, products = sum(found.values()) * self.k * self.starts, 0
        costs = [(beyond > V.CELLS, beyond * self.worth, 0)]
        for rows in sorted(r for r in found if r <= most):
            beyond -= found[rows] * self.k * self.starts
            products += found[rows] * rows * min(rows, self.parts) * self.starts
            costs.append((beyond > V.CELLS, beyond * self.worth + products, rows))
        return costs[-1][2] if costs[-1][0] else min(costs)[2]

    def _reader(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Block]]:
        width = self.width
        return lambda batches: (p.everywhere(width) for p in parts(batches))

    def _sent(self, centers: list[Centers], per: int) -> Sent:
        """Seeds, which have few of all components."""
        kept = np.unique(np.concatenate([cells % self.width for cells, _ in centers]))
        columns = len(centers) * per
        place = np.concatenate([np.searchsorted(kept, cells % self.width) * columns + (cells // self.width + i * per) for i, (cells, _) in enumerate(centers)])
        squares = [np.bincount(cells // self.width, x * x, per) for cells, x in centers]
        return Sent(place, np.concatenate([x for _, x in centers]), np.concatenate(squares), kept)

    # Rounds

    def _parted(self, cells: np.ndarray, x: np.ndarray) -> tuple[Centers, Centers]:
        """(common, rare) components of a row or of centers: common ones by their numbers among these, rare ones as they are."""
        at = cells % self.width
        line = np.minimum(np.searchsorted(self.common, at), max(0, len(self.common) - 1))
        seen = self.common[line] == at if len(self.common) else np.zeros(len(at), bool)
        return (cells[seen] // self.width * len(self.common) + line[seen], x[seen]), (cells[~seen], x[~seen])

    def _first(self, seeds: Centers) -> Start:
        common, (cells, x) = self._parted(*seeds)
        of = cells // self.width
        return Start(common, {c: (cells[of == c] % self.width, x[of == c]) for c in range(self.k)}, squares=np.bincount(seeds[0] // self.width, seeds[1] * seeds[1], self.k).astype(float))

    def _job(self, over: Callable[[Iterator[Part], Any], Iterator[pa.RecordBatch]], ddl: str, sent: Any) -> DataFrame:
        self.passes += 1
        if self.shared is not None:
            self.shared.destroy()  # the pass before is done
        shared = self.shared = self.spark.sparkContext.broadcast(sent)
        return self.packed.mapInArrow(lambda batches: over(parts(batches), shared.value), ddl)

    def _rounded(self, active: list[Start]) -> tuple[list[Centers], np.ndarray, np.ndarray, list[Centers], list[np.ndarray]]:
        """(sums of common components, sizes, costs, the row farthest from its center, labels) of each start."""
        starts, k, scale, cost_scale, ids_of, columns = len(active), self.k, self.scale, self.cost_scale, ARROW[self.kind], len(self.common)
        size = max(1, -(-starts * k * columns // V.ADDERS))
        kind = np.dtype(np.uint8 if k <= 2**8 else np.int32)

        def over(held: Iterator[Part], sent: list[Start]) -> Iterator[pa.RecordBatch]:
            sums, sizes, costs = np.zeros(starts * k * columns, np.int64), np.zeros(starts * k, np.int64), np.zeros(starts, np.int64)
            far: dict[int, tuple] = {}
            for part in held:
                block = part.block()
                number = np.full(len(part.cols), -1)
                number[part.common] = part.common_at
                common = number[block.at]
                seen = common >= 0
                of, common, whole = block.rows[seen], common[seen], np.rint(block.x[seen] * scale).astype(np.int64)
                for s, start in enumerate(sent):
                    m = start.rare(part, k, scale)
                    known = np.zeros((k, columns))
                    known.reshape(-1)[start.common[0]] = start.common[1]
                    m[part.common] = known[:, part.common_at].T
                    away = _distances(block, m, start.squares)
                    labels = away.argmin(axis=1)
                    least = away[np.arange(len(labels)), labels]
                    costs[s] += np.rint(least * cost_scale).astype(np.int64).sum()
                    sizes[s * k : (s + 1) * k] += np.bincount(labels, minlength=k)
                    np.add.at(sums, (labels[of] + s * k) * columns + common, whole)
                    i = int(least.argmax())
                    mine = (-float(least[i]), block.ids[i].as_py())
                    if s not in far or mine < far[s][0]:
                        at, x = block.row(i)
                        far[s] = (mine, (part.cols[at].tolist(), x))
                    told = [pa.array([-2 - starts - s], pa.int32()), pa.array([np.int64(part.first).tobytes()], pa.binary()), pa.array([labels.astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*told, pa.nulls(1, pa.float64()), pa.nulls(1, ids_of), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.float64()))], ["part", "place", "value", "key", "id", "at", "x"])
            if not far:
                return
            for a in range(0, len(sums), size):
                some = sums[a : a + size]
                if len(cells := np.flatnonzero(some)):
                    yield _summed(a // size, cells, some[cells], ids_of)
            yield _summed(-1, np.arange(starts * k + starts), np.concatenate([sizes, costs]), ids_of)
            for s, ((key, name), (at, x)) in far.items():
                yield _summed(-2 - s, np.array([]), np.array([]), ids_of, key, name, at, x)

        ddl = f"part int, place binary, value binary, key double, id {self.kind}, at array<int>, x array<double>"
        done = self._job(over, ddl, active).repartition("part").mapInArrow(_adder(size, starts * k + starts, starts, ids_of), ddl).toArrow()
        small, far, summed = np.zeros(starts * k + starts, np.int64), {}, {}
        labels = [np.zeros(self.n, kind) for _ in range(starts)]
        for part, place, value, at, x in zip(*(done[c] for c in ("part", "place", "value", "at", "x")), strict=True):
            part = part.as_py()
            if part < -1 - starts:
                first, found = int(np.frombuffer(place.as_buffer(), np.int64)[0]), np.frombuffer(value.as_buffer(), kind)
                labels[-2 - starts - part][first : first + len(found)] = found
            elif part < -1:
                far[-2 - part] = np.array(at.as_py(), np.int64), np.array(x.as_py(), np.float64)
            else:
                cells, values = np.frombuffer(place.as_buffer(), np.int32), np.frombuffer(value.as_buffer(), np.int64)
                if part >= 0:
                    summed[part] = cells.astype(np.int64) + part * size, values
                else:
                    small[cells] = values
        ordered = [summed[p] for p in sorted(summed)]
        cells, sums = (np.concatenate([p[i] for p in ordered] or [np.array([], np.int64)]) for i in range(2))
        cuts = np.searchsorted(cells, np.arange(starts + 1) * k * columns)
        listed = [(cells[a:b] - s * k * columns, sums[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return listed, small[: starts * k].reshape(starts, k), small[starts * k :], [far[s] for s in range(starts)], labels

    def _next(self, old: Start, sums: Centers, sizes: np.ndarray, far: Centers, labels: np.ndarray) -> Start:
        """A start's centers after a round, but for the squares of their rare components."""
        common_far, rare_far = self._parted(*far)
        common = self._moved(old.common, sums, sizes, common_far, max(1, len(self.common)))
        explicit = {}
        for i, c in enumerate(np.flatnonzero(sizes == 0).tolist()):
            explicit[c] = rare_far if i == 0 else old.explicit[c] if c in old.explicit else self._gathered(old, c)
        return Start(common, explicit, labels, sizes)

    def _gathered(self, start: Start, c: int) -> Centers:
        """Rare components of a center that lost its rows and stays."""
        k, scale = self.k, self.scale
        alone = replace(start, explicit={}, common=(np.array([], np.int64), np.array([])))

        def over(held: Iterator[Part], sent: Start) -> Iterator[pa.RecordBatch]:
            for part in held:
                m, mine = sent.rare(part, k, scale)[:, c], np.zeros(len(part.cols), bool)
                mine[part.shared[part.own]] = True
                found = np.flatnonzero(mine & (m != 0))
                yield pa.RecordBatch.from_arrays([pa.array(part.cols[found]), pa.array(m[found])], ["at", "x"])

        found = self._job(over, "at long, x double", alone).toArrow()
        at, x = (found[name].to_numpy() for name in ("at", "x"))
        order = at.argsort()
        return at[order], x[order]

    def _measured(self, fresh: list[Start], before: list[Start | None]) -> np.ndarray:
        """Sets the squares of fresh centers; how far the rare components of those with a start before have moved, in squares."""
        starts, k, scale, width = len(fresh), self.k, self.scale, max(1, len(self.common))

        def over(held: Iterator[Part], sent: Any) -> Iterator[pa.RecordBatch]:
            total, moved = np.zeros((starts, k, 6), np.int64), np.zeros(starts)
            for part in held:
                shared, places, whole = part.shared[part.own], part.places[part.own], part.whole[part.own]
                mine = np.zeros(len(part.cols), bool)
                mine[shared] = True
                number = np.cumsum(mine) - 1
                cuts = np.arange(0, max(1, int(mine.sum())), EXACT)
                for s, (new, old) in enumerate(zip(*sent, strict=True)):
                    sums = np.bincount(number[shared] * k + new.labels[places], whole, max(1, int(mine.sum())) * k).astype(np.int64).reshape(-1, k)
                    high, low = sums >> HALF, sums & (2**HALF - 1)
                    for i, (a, b) in enumerate(((high, high), (high, low), (low, low))):
                        products = np.add.reduceat(a * b, cuts, axis=0)
                        total[s, :, 2 * i] += (products >> HALF).sum(axis=0)
                        total[s, :, 2 * i + 1] += (products & (2**HALF - 1)).sum(axis=0)
                    if old is not None:
                        moved[s] += ((new.rare(part, k, scale)[mine] - old.rare(part, k, scale)[mine]) ** 2).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], ["total", "moved"])

        found = self._job(over, "total binary, moved binary", (fresh, before)).collect()
        totals = sum((np.frombuffer(r["total"], np.int64).reshape(starts, k, 6) for r in found), np.zeros((starts, k, 6), np.int64))
        for s, start in enumerate(fresh):
            cells, x = start.common
            start.squares = np.bincount(cells // width, x * x, k).astype(float)  # of none they are whole numbers
            for c in range(k):
                if c in start.explicit:
                    start.squares[c] += (start.explicit[c][1] ** 2).sum()
                else:
                    hh, hl, ll = ((int(totals[s, c, i]) << HALF) + int(totals[s, c, i + 1]) for i in (0, 2, 4))
                    start.squares[c] += ((hh << 2 * HALF) + (hl << HALF + 1) + ll) / (int(scale) * max(1, int(start.sizes[c]))) ** 2
        return np.array([math.fsum(np.frombuffer(r["moved"])[s] for r in found) for s in range(starts)])

    def _settled(self) -> tuple[int, int, np.ndarray] | None:
        """(cost, start, labels) of the cheapest start that settles with no empty cluster, the first of equals."""
        self.packed.count()
        self.counts.unpersist()
        width = max(1, len(self.common))
        room = max(1, min(V.CELLS // (self.k * width), V.CENTERS // self.k))
        seeds: list[tuple[int, Centers]] = []
        for a in range(0, self.starts, room):
            group = list(range(a, min(self.starts, a + room)))
            seeds += [(start, c if isinstance(c, tuple) else _filled(c.reshape(-1))) for start, c in zip(group, self._seeded(group), strict=True)]
        best, active, away = None, [], np.zeros(self.k * width)
        while seeds or active:
            while seeds and len(active) < room:
                start, centers = seeds.pop(0)
                active.append((start, self._first(centers), 1))
            sums, sizes, costs, far, labels = self._rounded([c for _, c, _ in active])
            going = []
            for s, (start, old, rounds) in enumerate(active):
                fresh = self._next(old, sums[s], sizes[s], far[s], labels[s])
                away[fresh.common[0]] = fresh.common[1]
                away[old.common[0]] -= old.common[1]
                least = (away**2).sum()  # as far as common components tell
                away[fresh.common[0]] = away[old.common[0]] = 0
                near = least <= self.settled and (sizes[s] > 0).all()
                same = near and old.labels is not None and not old.explicit and np.array_equal(old.labels, labels[s])
                going.append((start, old, rounds, fresh, least, near, same, int(costs[s])))
            done = [g for g in going if g[6]]
            going = [g for g in going if not g[6] and (g[5] or g[2] < self.iterations)]
            moved = self._measured([g[3] for g in going], [g[1] if g[5] else None for g in going]) if going else []
            active = []
            for g, rare in zip(going, moved, strict=True):
                if g[5] and g[4] + rare <= self.settled:
                    done.append(g)
                elif g[2] < self.iterations:
                    active.append((g[0], g[3], g[2] + 1))
            for start, *_, fresh, _, _, _, cost in done:
                best = min(best or (cost, start, fresh.labels), (cost, start, fresh.labels), key=lambda d: d[:2])
        return best

    def fit(self) -> tuple[DataFrame, float, None]:
        """((id, cluster), cost, None) of the cheapest start that settled, the first of equals."""
        best = self._settled()
        if not best:
            raise V.ClusteringError(f"no run found {self.k} clusters")
        cost, _, labels = best

        def over(held: Iterator[Part], sent: np.ndarray) -> Iterator[pa.RecordBatch]:
            for part in held:
                label = sent[part.first : part.first + len(part.h)]
                yield pa.RecordBatch.from_arrays([part.ids, pa.array(label.astype(np.int32))], ["id", "cluster"])

        return self._job(over, f"id {self.kind}, cluster int", labels), cost / self.cost_scale, None


def _adder(size: int, few: int, starts: int, ids_of: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the sums of a part and finds the farthest rows; labels go on as they are."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        far: dict[int, tuple] = {}
        for batch in batches:
            labels = pa.compute.less(batch.column(0), -1 - starts)
            yield batch.filter(labels)
            for row in zip(*batch.filter(pa.compute.invert(labels)).columns, strict=True):
                part = row[0].as_py()
                if part < -1:
                    mine = tuple(c.as_py() for c in row[3:])
                    far[part] = min(far.get(part, mine), mine, key=lambda m: m[:2])
                else:
                    total = totals.setdefault(part, np.zeros(size if part >= 0 else few, np.int64))
                    total[np.frombuffer(row[1].as_buffer(), np.int32)] += np.frombuffer(row[2].as_buffer(), np.int64)
        for part, total in totals.items():
            cells = np.flatnonzero(total)
            yield _summed(part, cells, total[cells], ids_of)
        for part, mine in far.items():
            yield _summed(part, np.array([]), np.array([]), ids_of, *mine)

    return added
