import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in usable:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in usable)
        near = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
        for j, best in near:
            fit = [(k, -s) for s, k, other in scored if other != label and 30 * best <= -100 * s <= 90 * best][:10]
            out += [(i, j, rank + 1, k, best, s) for rank, (k, s) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed, width=12, hot=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype("f4") / 3 + rng.normal(size=(1, width)).astype("f4") / 4
    v[rng.random(n) < hot] = v[0]
    return [(i, v[i].tolist(), int(rng.integers(10))) for i in range(n)]


def mined(spark, rows, parts=3):
    return sorted(map(tuple, hn.digest(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()))


@pytest.mark.parametrize("hot", [0, 0.4])
def test_against_brute_force(spark, hot):
    rows = vectors(700, 3, hot=hot)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_against_sql(spark):
    rows = vectors(900, 8, width=7)
    embeddings = spark.createDataFrame(rows, SCHEMA).toArrow()  # noqa: F841
    want = duckdb.sql(hn.SQL)
    got = hn.digest(spark.createDataFrame(rows, SCHEMA)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_small_blocks_and_groups_change_nothing(spark, monkeypatch):
    rows = vectors(1500, 4)
    want = brute(rows)
    monkeypatch.setattr(hn, "BLOCK", 3)
    assert mined(spark, rows) == want


def test_groups_within_a_task():
    """Several groups of rows, one task: floors carried from group to group lose nothing."""
    rows = vectors(800, 6, hot=0.2)
    v = np.floor(256 * np.array([r[1] for r in rows], "f4").astype("f8"))
    ids, labels = np.arange(len(rows)), np.array([r[2] for r in rows])
    book = hn.fitted(v[:300], v.shape[1])
    codes, norms = book.encode(v)
    block = hn.Anchors(ids[::40], labels[::40], v[::40], np.zeros((0, 3), np.int64))
    results = []
    for step in (800, 50):
        best = hn.Best(len(block.ids), 5)
        for a in range(0, 800, step):
            part = slice(a, a + step)
            hn._positives(block, book, 5, best, hn.Rows(ids[part], labels[part], codes[part], norms[part], v[part]))
        block.windows = np.stack([best.lists, -(-30 * best.scores // 100), 90 * best.scores // 100], axis=1)
        lists = hn.Best(len(best.lists), 10)
        for a in range(0, 800, step):
            part = slice(a, a + step)
            hn._negatives(block, book, 10, lists, hn.Rows(ids[part], labels[part], codes[part], norms[part], v[part]))
        results.append([x.tolist() for x in (best.lists, best.ids, best.scores, lists.lists, lists.ids, lists.scores)])
    assert results[0] == results[1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_bounds_hold(seed, width):
    """Every score lies within its bounds, whatever the centres were fitted to."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-300, 300, size=(40, width)).astype(float)
    book = hn.fitted(v[: rng.integers(0, 40)], width)
    padded = np.pad(v, ((0, 0), (0, book.width - width)))
    codes, norms = book.encode(padded)
    block = hn.Anchors(np.arange(40), np.zeros(40), padded, np.zeros((0, 3), np.int64))
    low, high = block.scored(book, np.arange(40), codes, norms)
    scores = padded @ padded.T
    assert (low <= scores).all() and (scores <= high).all()


def test_rows_that_take_no_part(spark):
    rows = vectors(300, 9)
    odd = [(100, None, 1), (200, [0.1] * 12, None), (None, [0.2] * 12, 3), (301, [float("nan")] * 12, 2), (302, [float("inf")] + [0.1] * 11, 2), (303, [None] + [0.1] * 11, 2)]
    rows = [r for r in rows if r[0] not in (100, 200)] + odd
    assert mined(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    same = [(i, [0.5, 0.25, 0.5], i % 3) for i in range(400) if i % 7] + [(i, [0.4, 0.2, 0.4], 5) for i in range(400, 500) if i % 7]
    assert mined(spark, same) == brute(same)
    twice = vectors(150, 2) + [(3, [0.3] * 12, 4), (3, [0.3] * 12, 4)]
    got = mined(spark, twice)
    assert got == brute(twice)


def test_shorter_vectors_and_clashing_columns(spark):
    rows = [(i, [0.1 * (i % 5 + 1)] * (i % 4), i % 2) for i in range(210)]
    assert mined(spark, rows) == brute(rows)
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rank", "1 as list", "2 as codes", "3 as v")
    assert sorted(map(tuple, hn.digest(more).collect())) == brute(rows)


def test_sums_stay_exact():
    """The kind of numbers for a norm holds sums of products up to it, in any order."""
    assert hn.exact_kind(4095) is np.float32 and hn.exact_kind(4096) is np.float64
    rng = np.random.default_rng(1)
    for scale in (700, 60_000):
        v = rng.integers(-scale, scale, size=(200, 32))
        kind = hn.exact_kind(int(np.sqrt((v * v).sum(1)).max()) + 1)
        assert (hn._exact(v.astype(kind), v[0].astype(kind)) == v @ v[0]).all()


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []
    assert mined(spark, [(100, [0.5], 1), (101, [0.5], 2)]) == []  # no positive
    assert mined(spark, [(100, [-0.5], 1), (101, [0.5], 1), (102, [0.1], 2)]) == []  # a score below zero has no window
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(100, [1e9], 1)])


def test_null_lists_in_a_slice():
    lists = pa.array([[1.0], None, [0.5, None], [0.25, 0.5]], pa.list_(pa.float32())).slice(1)
    places, v = hn.whole(lists)
    assert places.tolist() == [2] and v.tolist() == [[64, 128]]


def test_most_rows_are_left_to_their_bounds():
    """At the production parameters a small part of the rows is scored exactly."""
    rows = vectors(6000, 1, width=64)
    v = np.floor(256 * np.array([r[1] for r in rows], "f4").astype("f8"))
    book = hn.fitted(v, 64)
    codes, norms = book.encode(v)
    assert norms.mean() < 0.15 * np.sqrt((v * v).sum(1)).mean()
    assert codes.shape == (6000, 32)
