"""K-means and the decomposition against plain versions on one matrix."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import vectors as V
from assayer.operators.vectors import ClusteringError

M64 = 2**64 - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M64
    return x ^ x >> 31


def draw(h, seed, start, step, trial):
    bits = mixed((h & M64) ^ mixed((((seed * 1009 + start) * 65_537 + step) * 257 + trial) & M64)) >> 11
    return -math.log((bits + 0.5) / 2.0**53)


def apart(x, centers):
    """Squared distances, rounded as they are compared."""
    return [[max(round(float(((p - c) ** 2).sum()), 10), 0.0) for c in centers] for p in x]


def brute(rows, k, starts, seed=42, rounds=300, tolerance=1e-4):
    """Labels and cost of the best start, one start after the other, row by row. rows: (id, h, vector)."""
    x = np.array([r[2] for r in rows])
    settled = tolerance * float(((x**2).mean(axis=0) - x.mean(axis=0) ** 2).mean())
    trials, best = 2 + int(math.log(k)), None
    for start in range(starts):
        key = [(draw(h, seed, start, 0, 0), i) for i, h, _ in rows]
        centers = [x[[r[0] for r in rows].index(min(key)[1])]]
        for step in range(1, k):
            near = [min(d) for d in apart(x, centers)]
            tried = []
            for t in range(trials if step > 0 else 1):
                keys = [(draw(h, seed, start, step, t) / near[n], i, n) for n, (i, h, _) in enumerate(rows) if near[n] > 0]
                tried.append(x[min(keys)[2]])
            totals = [sum(min(a, b[0]) for a, b in zip(near, apart(x, [c]), strict=True)) for c in tried]
            centers.append(tried[min(range(len(tried)), key=lambda t: (round(totals[t], 7), t))])
        for _ in range(rounds):
            away = apart(x, centers)
            labels = [d.index(min(d)) for d in away]
            fresh = []
            for j in range(k):
                mine = [p for p, label in zip(x, labels, strict=True) if label == j]
                fresh.append(np.mean(mine, axis=0) if mine else centers[j])
            empty = [j for j in range(k) if j not in labels]
            if empty:
                fresh[empty[0]] = x[min(range(len(x)), key=lambda n: (-min(away[n]), rows[n][0]))]
            moved = sum(float(((a - b) ** 2).sum()) for a, b in zip(fresh, centers, strict=True))
            if moved <= settled and not empty:
                cost = sum(min(d) for d in away)
                if best is None or cost < best[1] - 1e-9:
                    best = (labels, cost)
                break
            centers = fresh
    return {r[0]: label for r, label in zip(rows, best[0], strict=True)}, best[1]


def blobs(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    return (centers[rng.integers(6, size=n)] + rng.normal(size=(n, width)) * 0.35).round(6)


def held(spark, x, sparse=False, parts=3, names=None):
    names = names or list(range(len(x)))
    if sparse:
        rows = [(i, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for i, v in zip(names, x, strict=True)]
        return V.stored_vectors(spark.createDataFrame(rows, f"id {'string' if isinstance(names[0], str) else 'long'}, at array<int>, x array<double>").repartition(parts), "at")
    return V.stored_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(names, x, strict=True)], "id long, x array<double>").repartition(parts))


def plain_rows(vectors, x, names=None):
    hashes = {r.id: r.h for r in vectors.select("id", "h").collect()}
    return [(i, hashes[i], x[n]) for n, i in enumerate(names or range(len(x)))]


def test_five_hundred_vectors_against_brute_force(spark):
    x = blobs(500, 8, 1)
    vectors = held(spark, x)
    km = V.KMeans(vectors.persist(), 6, starts=4)
    got, cost, _ = km.fit()
    labels, want = brute(plain_rows(vectors, x), 6, 4)
    assert {r.id: r.cluster for r in got.collect()} == labels and cost == pytest.approx(want, rel=1e-7)
    assert km.passes < 60
    vectors.unpersist()


def test_parts_and_groups_of_starts_change_nothing(spark, monkeypatch):
    x = blobs(200, 5, 2)
    want, cost = V.kmeans(held(spark, x, parts=1), 4, 5)
    monkeypatch.setattr(V, "CELLS", 40)  # two starts at a time, chunks of a few products
    for sparse in (False, True):
        got, again = V.kmeans(held(spark, x, sparse, parts=7), 4, 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and again == cost


def test_sparse_rows_with_empty_ones(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((120, 40)) < 0.1, rng.random((120, 40)), 0).round(5)
    x[[0, 50]] = 0
    names = [f"t{i:03}" for i in range(120)]
    vectors = held(spark, x, True, names=names)
    got, cost, _ = V.KMeans(vectors, 5, starts=3, width=40).fit()
    labels, want = brute(plain_rows(vectors, x, names), 5, 3)
    assert {r.id: r.cluster for r in got.collect()} == labels and cost == pytest.approx(want, rel=1e-7)


def test_an_empty_cluster_takes_the_farthest_row(spark):
    """A round in which a center has no rows: it moves to the row that is farthest from its own."""
    x = np.array([[0.0], [0.1], [0.2], [10.0], [30.0]])
    km = V.KMeans(held(spark, x), 3, starts=1)
    km._seeded = lambda group: np.array([[[0.1], [500.0], [10.0]]])
    got = {r.id: r.cluster for r in km.fit()[0].collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 1}


def test_repeated_rows_and_what_cannot_be_clustered(spark):
    x = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3)
    got, cost = V.kmeans(held(spark, x), 2, 3)
    labels = {r.id: r.cluster for r in got.collect()}
    assert len({labels[i] for i in range(30)}) == 1 and len(set(labels.values())) == 2 and cost == 0
    assert V.distinct(held(spark, x)) == 2
    for k, rows in ((3, x), (40, x), (0, x)):
        with pytest.raises(ClusteringError):
            V.kmeans(held(spark, rows), k, 2)
    with pytest.raises(ClusteringError, match="finite"):
        V.kmeans(held(spark, np.array([[1.0], [math.nan]])), 1, 1)


@pytest.mark.parametrize("sparse", [False, True])
def test_singular_values_are_numpys(spark, sparse):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((150, 60)) < 0.2, rng.random((150, 60)), 0)
    x[7] = 0
    made, values = V.decomposed(held(spark, x, sparse), 60, 5)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s[:5], rel=1e-9)
    rows = {r.id: np.array(r.x) for r in made.collect()}
    assert np.allclose(rows[7], 0)
    want = u[:, :5] * s[:5]
    for i in set(range(150)) - {7}:
        assert np.linalg.norm(rows[i]) == pytest.approx(1) and np.abs(rows[i] * np.sign(rows[i])) == pytest.approx(np.abs(want[i]) / np.linalg.norm(want[i]), abs=1e-6)


def test_few_directions_are_enough(spark):
    """A spectrum without gaps, and one of lower rank than asked for."""
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(300, 40))
    assert V.decomposed(held(spark, flat), 40, 3)[1] == pytest.approx(np.linalg.svd(flat)[1][:3], rel=1e-6)
    low = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 30))
    values = V.decomposed(held(spark, low), 30, 4)[1]
    assert values[:2] == pytest.approx(np.linalg.svd(low)[1][:2], rel=1e-9) and values[2:] == pytest.approx([0, 0], abs=1e-9)
    for components in (0, 40):
        with pytest.raises(ClusteringError):
            V.decomposed(held(spark, flat), 40, components)


def test_draws_follow_weights():
    """The row of the least draw / weight is one by weight."""
    h = np.array([random.Random(i).getrandbits(63) for i in range(3)])
    weights, taken = np.array([1.0, 2.0, 5.0]), np.zeros(3)
    for start in range(4000):
        taken[(V.draws(h, 1, start, 1, 0) / weights).argmin()] += 1
    assert taken / 4000 == pytest.approx(weights / 8, abs=0.03)


def test_measures(spark):
    x = blobs(60, 4, 9)
    for sparse in (False, True):
        n, width, largest, variance = V.measured(held(spark, x, sparse))
        assert (n, width) == (60, 4) and largest == np.abs(x).max() and variance == pytest.approx(x.var(axis=0).mean())
    assert V.measured(held(spark, x).filter(F.lit(False)))[:2] == (0, 0)


def test_a_start_that_settles_makes_room_for_the_next(spark, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 40)  # two starts at a time
    km = V.KMeans(held(spark, blobs(200, 5, 2)), 4, 7)
    under_way, whole = [], km._round
    monkeypatch.setattr(km, "_round", lambda centers: (under_way.append(len(centers)), whole(centers))[1])
    km.fit()
    assert under_way == sorted(under_way, reverse=True) and under_way[0] == 2
