import hashlib
from collections import defaultdict

from assayer.llm import exact_dedup as ed


def normal(text):
    return (text or "").encode().lower()


def test_against_brute_force(documents):
    groups = defaultdict(list)
    rows = documents.collect()
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    want = sorted((r.doc_id, max(g), len(g), r.doc_id == max(g), hashlib.sha256(normal(r.text)).hexdigest()) for r in rows for g in [groups[normal(r.text)]])
    assert sorted(map(tuple, ed.digest(documents).collect())) == want
    assert any(w[2] > 2 for w in want)


def test_shuffled_join_gives_the_same(documents, monkeypatch):
    want = sorted(map(tuple, ed.digest(documents).collect()))
    monkeypatch.setattr(ed, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, ed.digest(documents).collect())) == want


def test_only_ascii_letters_are_lowered(spark):
    docs = spark.createDataFrame([(1, "É A"), (2, "é a"), (3, "É a"), (4, "K"), (5, "k")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in ed.exact_dedup(docs).collect()} == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_odd_rows(odd, empty):
    got = ed.exact_dedup(odd)
    assert set(odd.columns) < set(got.columns)
    rows = got.collect()
    copies = [r for r in rows if r.text == "one two three four five six"]
    assert {(r.keep_id, r.group_size) for r in copies} == {(2, 6)}
    assert sum(r.kept for r in copies) == 1
    assert [(r.keep_id, r.kept) for r in rows if r.text == "by itself"] == [(None, True)]
    assert sum(r.kept for r in rows) == len({normal(r.text) for r in odd.collect()})
    assert ed.exact_dedup(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(7, "Aa"), (7, "Aa"), (7, "aa"), (3, "aa")], "doc_id long, text string")
    rows = ed.exact_dedup(docs).collect()
    assert [(r.doc_id, r.text) for r in rows if r.kept] == [(7, "Aa")]
    assert {r.group_size for r in rows} == {4}


def test_full_bitmaps_lose_nothing(documents, monkeypatch):
    want = sorted(map(tuple, ed.digest(documents).collect()))
    monkeypatch.setattr(ed, "LEAST_BITS", 1)
    monkeypatch.setattr(ed, "MOST_BITS", 8)
    assert sorted(map(tuple, ed.digest(documents).collect())) == want


def test_sql_has_the_same_rule_for_repeated_rows(odd):
    import duckdb
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(2, None), (2, ""), (None, "by itself")]
    held = duckdb.connect()
    held.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    got = ed.digest(odd.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(held.execute(ed.SQL).fetchall(), key=key)


def test_only_hashes_of_copies_are_made_in_python(documents):
    maybe, alone = ed._refined(documents, "text")
    assert maybe.count() + alone.count() == documents.count() and alone.count() > 0
    assert "Python" not in maybe._jdf.queryExecution().toString() and "Arrow" not in maybe._jdf.queryExecution().toString()
