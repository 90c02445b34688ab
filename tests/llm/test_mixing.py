from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing


def water_fill(sizes):
    """Targets by resharing the excess until none is above."""
    total, weights = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    target, fixed = [0.0] * len(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in fixed)
        free = sum(w for i, w in enumerate(weights) if i not in fixed)
        target = [3 * s if i in fixed else left * weights[i] / free for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if i not in fixed and t > 3 * sizes[i]}
        if not over:
            return target
        fixed |= over


def test_targets_follow_the_resharing_loop(spark):
    for sizes in ([10, 1000, 1000], [5, 5, 5, 5000], [1, 2, 3, 4, 1000, 0, 7], [3]):
        rows = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "skey string, source_size long")
        got = [r.target for r in mixing.targets(rows).orderBy("skey").collect()]
        assert got == pytest.approx(water_fill(sizes))


def test_taken_is_near_the_targets(documents):
    rows = mixing.digest(documents).collect()
    texts = {r.doc_id: len((r.text or "").split()) for r in documents.collect()}
    names = {r.doc_id: r.source for r in documents.collect()}
    taken, target, small = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        source = names[r.doc_id]
        assert r["size"] == texts[r.doc_id] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[source] += r.taken
        target[source] = r.target
        if r["size"] <= mixing.STRATA[1]:
            small[source] = max(small[source], r["size"])
    assert len(rows) == len(texts) and sorted(target.values()) == pytest.approx(sorted(water_fill([r[1] for r in sizes(names, texts)])))
    assert all(abs(taken[s] - t) <= small[s] / 2 + 1e-6 for s, t in target.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.digest(documents.repartition(7)).collect()))


def sizes(names, texts):
    held = defaultdict(int)
    for i, s in names.items():
        held[s is None, s or ""] += texts[i]
    return sorted(held.items())


def test_mix_is_sorted_and_follows_the_schedules(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("a b c d").alias("text"))
    parts = mixing.mix(docs).rdd.glom().collect()
    flat = [r.position for p in parts for r in p]
    assert flat == sorted(flat) and flat and 0 <= flat[0] and flat[-1] <= 1
    # slopes are -0.5, 0, 0.5 of weights 1, 2, 3: the first half takes 5/8, 4/8 and 3/8 of each source
    early = defaultdict(list)
    for p in parts:
        for r in p:
            early[r.source].append(r.position < 0.5)
    assert [sum(v) / len(v) for _, v in sorted(early.items())] == pytest.approx([5 / 8, 4 / 8, 3 / 8], abs=0.01)


def test_given_schedules_are_integrated(spark):
    """Times of a schedule with several pieces, against sums over a fine grid."""
    knots = [("s0", 0.0, 0.0), ("s0", 0.5, 4.0), ("s0", 0.5, 1.0), ("s0", 1.0, 0.0), ("s1", 0.25, 1.0), ("s1", 0.75, 3.0), ("s2", 0.1, -5.0), ("s2", float("nan"), 9.0), (None, 0.0, 2.0)]
    docs = spark.createDataFrame([(i, None if i % 5 == 4 else f"s{i % 5}", "a b c d") for i in range(4000)], "doc_id long, source string, text string")
    rows = mixing.plan_mix(docs, knots=spark.createDataFrame(knots, "source string, t double, weight double")).collect()
    shapes = {"s0": lambda t: 8 * t if t < 0.5 else 8 - 8 * t, "s1": lambda t: min(max(1 + 4 * (t - 0.25), 1), 3), "s3": lambda t: 1.0, None: lambda t: 2.0}
    # s3 has no knots: it is the fourth source by name, of weight 1 and slope -0.5
    shapes["s3"] = lambda t: 1.5 - t
    areas = {k: sum(f((i + 0.5) / 20000) for i in range(20000)) / 20000 for k, f in shapes.items()}
    target = {r.source: r.target for r in rows}
    assert target["s2"] == 0 and {r.copies for r in rows if r.source == "s2"} == {0}
    free = {k: target[k] / areas[k] for k in shapes if target[k] < 3 * 3200 - 1}
    assert len(free) >= 2 and max(free.values()) == pytest.approx(min(free.values()), rel=1e-6)
    for source, shape in shapes.items():
        times = sorted(t for r in rows if r.source == source for t in r.positions)
        for share in (0.1, 0.37, 0.5, 0.8, 0.99):
            t = times[int(share * len(times))]
            done = sum(shape((i + 0.5) / 20000) for i in range(int(t * 20000))) / 20000
            assert done / areas[source] == pytest.approx(share, abs=0.01)


def test_odd_rows(odd, empty):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == odd.count()
    assert mixing.digest(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in mixing.digest(blank).collect()} == {0}
