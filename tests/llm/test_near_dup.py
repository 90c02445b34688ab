import random

import numpy as np
import pytest

from assayer.llm import near_dup as nd


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k):
    """doc_id -> (n, component, kept)."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def changed(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def families(k, seed=5):
    """Chains and large groups of copies at all distances around the threshold, with a passage shared by many."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for size, n in ((30, 25), (60, 40), (120, 20)):
        base = [f"b{rng.randrange(10**5)}" for _ in range(size)]
        texts += [" ".join(changed(base, rng.randint(0, max(1, size // (6 * k))), rng)) for _ in range(n)]
        chain = base
        for _ in range(6):
            chain = changed(chain, max(1, size // (10 * k)), rng)
            texts.append(" ".join(chain))
    texts += [" ".join([f"u{rng.randrange(10**5)}" for _ in range(rng.choice((4, 6, 9, 12, 40)))] + passage) for _ in range(60)]
    texts += ["A b", "a B", "a", "A", "", None, "a b c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(spark, k):
    rows = families(k)
    got = nd.near_dup(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_corpus_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, nd.digest(documents).collect())) == brute(rows, 2)


def test_prefix_filter_loses_no_pair(spark):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 90, dtype=np.uint64)
        for _ in range(8):
            keep = base[rng.random(90) > rng.uniform(0, 0.2)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])))
    rows = [(bytes([i]), s.tobytes(), bytes([i])) for i, s in enumerate(sets)]
    got = {frozenset((r.a[0], r.b[0])) for r in nd.prefix_pairs(spark.createDataFrame(rows, "cls binary, hashes binary, label binary")).collect()}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in got


def test_bands_find_pairs_at_the_threshold():
    rng, circle, found = np.random.default_rng(2), nd._circle(), []
    for _ in range(400):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
        x, y = (nd.bands(nd.signature(np.concatenate([common, s]), circle)) for s in (a, b))
        found.append((x == y).sum())
    assert min(found) > 0 and abs(np.mean(found) / nd.BANDS - 0.8**nd.ROWS) < 0.03


def test_signature_is_the_circulant_definition():
    circle, s = nd._circle(), np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    places, pi = nd._sigma(s), circle[: nd.DIM]
    assert len(np.unique(nd._sigma(np.arange(nd.DIM, dtype=np.uint64)))) == nd.DIM
    assert sorted(pi.tolist()) == list(range(nd.DIM))
    want = [pi[(places + k) % nd.DIM].min() for k in range(nd.COORDS)]
    assert nd.signature(s, circle).tolist() == want


def test_sketch_bounds_the_intersection():
    rng = np.random.default_rng(3)
    for n in (5, 300, 70_000):
        a, b = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        b[: n // 2] = a[: n // 2]
        x, y = nd.sketch(a), nd.sketch(b)
        full = (x == 255).any() or (y == 255).any()
        assert full or np.minimum(x, y).astype(int).sum() >= len(np.intersect1d(a, b))


def test_odd_rows(odd, empty):
    rows = nd.near_dup(odd, 2).collect()
    assert len(rows) == odd.count()
    assert {(r.component_id, r.n_shingles) for r in rows if r.n_shingles == 5} == {(0, 5)}
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id in (3, 4)] == [(0, 3, True), (0, 4, True)]
    assert nd.near_dup(empty, 2).count() == 0
    blank = odd.selectExpr("doc_id", "' ' as text")
    assert all(r.n_shingles == 0 and r.kept for r in nd.near_dup(blank, 5).collect())


def test_shuffled_join_gives_the_same(documents, monkeypatch):
    want = sorted(map(tuple, nd.digest(documents).collect()))
    monkeypatch.setattr(nd, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, nd.digest(documents).collect())) == want


def test_hot_keys_met_by_broadcast_give_the_same(spark, monkeypatch):
    """Chains, a star and pairs, with every key hot and with none."""
    from assayer.llm import common, connected

    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(300 + 2 * i, 301 + 2 * i) for i in range(20)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: 100 for n in range(100, 161)} | {n: 5 for n in [5, *range(200, 260)]} | {300 + 2 * i + k: 300 + 2 * i for i in range(20) for k in (0, 1)}
    for few, hot in ((2**17, 1024), (0, 1024), (0, 0), (0, 4)):
        monkeypatch.setattr(connected, "FEW_EDGES", few)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_KEYS", 10**9)
        assert {r.node: r.label for r in connected.components(df, "a", "b").collect()} == want
