"""K-means over components too many to be sent: as K-means that sends them all, row by row."""

import numpy as np
import pytest

from assayer.operators import vectors as V
from assayer.operators import wide as W
from tests.test_vectors import brute, held, plain_rows


def rare(n, width, seed):
    """Rows of a topic's words and of words that two to four rows have."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, width))
    for i, topic in enumerate(rng.integers(4, size=n)):
        x[i, topic * 3 + rng.integers(3, size=2)] = rng.random(2)
    for j in range(12, width):
        x[rng.integers(n, size=3), j] = rng.random(3)
    x[[0, n // 2]] = 0
    return x.round(5)


def labels(found):
    return {r.id: r.cluster for r in found.collect()}


@pytest.mark.parametrize(("cells", "most"), [(2 * 4 * 4, 2), (5 * 4 * 12, 256), (2 * 4 * 90, 0)])
def test_rare_components_change_nothing(spark, monkeypatch, cells, most):
    """Starts in groups, all at once, and without any component that is rare."""
    x = rare(160, 90, 1)
    names = [f"t{i:03}" for i in range(160)]
    vectors = held(spark, x, True, names=names)
    want, cost, _ = V.KMeans(vectors, 4, starts=5).fit()
    monkeypatch.setattr(V, "CELLS", cells)
    monkeypatch.setattr(W, "PART", 60)
    monkeypatch.setattr(W, "RARE", most)
    km = W.WideKMeans(vectors, 4, starts=5)
    got, again, _ = km.fit()
    assert labels(got) == labels(want) and again == cost
    assert (len(km.common) < 90) == (most > 0)
    assert labels(got) == brute(plain_rows(vectors, x, names), 4, 5)[0]


def test_wide_vectors_take_all_starts_in_a_pass(spark, monkeypatch):
    """Where centers of all components had room for one start, and passes were made for each of 6."""
    vectors = held(spark, rare(160, 90, 2), True)
    monkeypatch.setattr(V, "CELLS", 4 * 90)
    plain = V.KMeans(vectors, 4, starts=6)
    want, cost, _ = plain.fit()
    made = []
    whole = W.WideKMeans._rounded
    monkeypatch.setattr(W.WideKMeans, "_rounded", lambda self, active: (made.append((self, len(active))), whole(self, active))[1])
    got, again = V.kmeans(vectors, 4, 6)
    assert labels(got) == labels(want) and again == cost
    assert made[0][1] == 6 and made[0][0].passes < plain.passes


def test_centers_without_rows(spark, monkeypatch):
    """Two centers lose their rows: one takes the farthest row, the other stays, first as a seed and then as what its rows made."""
    x = rare(60, 40, 3)
    vectors = held(spark, x, True)
    monkeypatch.setattr(V, "CELLS", 4 * 2 * 12)
    seeds = np.zeros((1, 4, 40))
    seeds[0, 0], seeds[0, 1], seeds[0, 2, 11], seeds[0, 3, 39] = x[1], x[2], 50, 70
    results = []
    for kind in (V.KMeans, W.WideKMeans):
        km = kind(vectors, 4, starts=1)
        km._seeded = lambda group: seeds
        got, cost, _ = km.fit()
        results.append((labels(got), cost))
    assert results[0] == results[1]
    of = (np.arange(60) % 4).astype(np.uint8)
    start = W.Start((np.array([], int), np.array([])), labels=of, sizes=np.bincount(of))
    at, found = km._gathered(start, 2)
    mean = x[of == 2].mean(axis=0)
    mean[km.common] = 0
    assert at.tolist() == np.flatnonzero(mean).tolist() and found == pytest.approx(mean[at])


def test_squares_and_steps_of_rare_components(spark, monkeypatch):
    x = rare(60, 40, 4)
    monkeypatch.setattr(V, "CELLS", 3 * 12)
    km = W.WideKMeans(held(spark, x, True), 3, starts=1)
    before, after = (W.Start((np.array([], int), np.array([])), labels=((np.arange(60) + d) % 3).astype(np.uint8), sizes=np.full(3, 20)) for d in (0, 1))
    moved = km._measured([after], [before])
    one, two = (np.array([np.delete(x, km.common, axis=1)[s.labels == c].mean(axis=0) for c in range(3)]) for s in (before, after))
    assert after.squares == pytest.approx((two**2).sum(axis=1)) and moved[0] == pytest.approx(((two - one) ** 2).sum())
