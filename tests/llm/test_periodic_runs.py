import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import periodic_runs as pr


def brute(words):
    """Every stretch whose period is the smallest, by comparing words one by one."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def told(doc_id, text):
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def repeats(rng, n):
    words = []
    while len(words) < n:
        cycle = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 14))]
        m = rng.randint(1, 70)
        words += (cycle * m)[:m]
    return words


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 250), st.booleans())
def test_runs_against_brute_force(seed, n, gated):
    words = [w.encode() for w in repeats(random.Random(seed), n)]
    before = pr.GATE
    try:
        pr.GATE = 0 if gated else before
        assert pr.runs(words) == brute(words)
    finally:
        pr.GATE = before


@given(st.lists(st.integers(0, 1), max_size=200), st.integers(1, 40))
def test_shift_doubling(bits, length):
    number = sum(b << i for i, b in enumerate(bits))
    starts = [i for i in range(len(bits)) if bits[i : i + length] == [1] * length]
    assert pr.isolated(number, length) == sum(1 << i for i in starts)


def test_planes_tell_words_apart():
    for n in (1, 2, 3, 1000, 65_537):
        numbers = np.arange(n)
        bits = pr.planes(numbers)
        seen = {tuple(p >> i & 1 for p in bits) for i in range(min(n, 2000))}
        assert len(seen) == min(n, 2000) and (1 << len(bits)) >= n


def test_least_lengths():
    assert pr.runs([b"x"] * 23) == [] and pr.runs([b"x"] * 24) == [(0, 24, 1)]
    nine = [bytes([97 + i]) for i in range(9)]
    assert pr.runs(nine * 3) == [(0, 27, 9)] and pr.runs((nine * 3)[:26]) == []
    assert pr.runs([b"y", *([b"a", b"b"] * 13), b"z"]) == [(1, 26, 2)]  # 4, 6, 8 are periods too


def test_a_very_long_text_of_few_words():
    words = [b"x"] * 40_000 + [b"y"] + [b"a", b"b"] * 20_000
    assert pr.runs(words) == [(0, 40_000, 1), (40_001, 40_000, 2)]


@pytest.fixture(scope="module")
def repeating(spark):
    rng = random.Random(5)
    texts = [" ".join(repeats(rng, rng.randint(0, 400))) for _ in range(150)] + [None, "", " \t\n", "one", "é é " * 30, "\x0bA a\x0cA\n" * 40, "\x1c x" * 30, "漢字 " * 24]
    return spark.createDataFrame([(i, t, None, True) for i, t in enumerate(texts)], "doc_id long, text string, runs string, best boolean")


def test_rows_against_brute_force(repeating):
    got = sorted(map(tuple, pr.digest(repeating).collect()))
    want = sorted(told(r.doc_id, r.text) for r in repeating.collect())
    assert got == want and any(r[1] > 1 for r in got)


def test_rows_against_sql(repeating):
    documents = repeating.select("doc_id", "text").toArrow()  # noqa: F841
    rows = duckdb.sql(pr.SQL)
    assert sorted(rows.fetchall()) == sorted(map(tuple, pr.digest(repeating).select(*rows.columns).collect()))


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end"), (None, "x " * 30)], "name int, body string")
    got = {r.doc_id: r for r in pr.periodic_runs(docs, "name", "body").collect()}
    assert got[1].collapsed == "start a b c end" and [tuple(x) for x in got[1].runs] == [(1, 30, 3)]
    assert got[None].collapsed == "x"


def test_odd_rows(spark, odd, empty):
    rows = pr.digest(odd).collect()
    assert len(rows) == odd.count() and {r.n_runs for r in rows} == {0}
    none = hashlib.sha256(b"").hexdigest()
    assert all(r.runs_sha256 == none and r.start is None for r in rows)
    assert [r.collapsed_sha256 for r in rows if r.doc_id == 4] == [none]
    assert pr.digest(empty).count() == 0


def test_no_shuffle(repeating):
    plan = pr.digest(repeating)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
