import zlib

import numpy as np
import pytest

from assayer.llm import concat_cut as cc

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def encoded(rows):
    library = tokenizers.Tokenizer.from_file(PATH)
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_one_line_cut_into_windows(spark, documents, parts):
    """Pieces, put side by side, are every document's ids once, and all windows but the last are full."""
    docs = documents.repartition(parts)
    want = encoded([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted(cc.digest(docs, PATH).collect(), key=lambda r: (r.sequence_id, r.offset))
    line, left = 0, {i: 0 for i in want}
    for r in got:
        assert r.sequence_id * cc.LENGTH + r.offset == line and r.offset + r.length <= cc.LENGTH
        assert r.start == left[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        line, left[r.doc_id] = line + r.length, r.start + r.length
    assert left == {i: len(ids) for i, ids in want.items()}
    assert max(r.sequence_id for r in got) == (line - 1) // cc.LENGTH


def test_sequences_hold_the_ids(spark, documents):
    want = encoded([(r.doc_id, r.text) for r in documents.collect()])
    rows = cc.sequences(documents.repartition(7), PATH, length=100).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u2").tolist(), 0
        assert r.n_tokens == len(ids) and (r.n_tokens == 100 or r.sequence_id == len(rows) - 1)
        for p in r.pieces:
            assert p.at == at and ids[at : at + p.length] == want[p.doc_id][p.start : p.start + p.length]
            at += p.length
        assert at == len(ids)


def test_a_window_over_many_partitions(spark):
    """Partitions of a few ids each: their records meet in the windows that they share."""
    docs = spark.createDataFrame([(i, "a b") for i in range(64)], "doc_id long, text string").repartition(64)
    rows = cc.sequences(docs, PATH, length=50).collect()
    n = len(encoded([(0, "a b")])[0]) * 64
    assert sum(r.n_tokens for r in rows) == n and len(rows) == -(-n // 50)
    assert sorted(p.doc_id for r in rows for p in r.pieces if p.start == 0) == list(range(64))


def test_no_window_is_left_over(spark):
    docs = spark.createDataFrame([(i, None) for i in range(8)], "doc_id long, text string").coalesce(1)
    rows = cc.sequences(docs, PATH, length=4).collect()
    assert [r.n_tokens for r in rows] == [4, 4] and all(np.frombuffer(r.ids, "<u2").tolist() == [2] * 4 for r in rows)


def test_odd_rows(spark, odd, empty):
    got = cc.digest(odd, PATH).collect()
    assert sum(r.start == 0 for r in got) == odd.count()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert sum(r.doc_id is None for r in got) == 2
    assert cc.digest(empty, PATH).count() == 0
    clash = odd.withColumnsRenamed({"size": "ids", "kept": "part"})
    assert cc.digest(clash, PATH).count() == len(got)


def test_a_very_long_text(spark):
    words = " ".join(f"word{i}" for i in range(60_000))
    got = cc.digest(spark.createDataFrame([(1, words), (2, "short")], "doc_id long, text string").coalesce(1), PATH).orderBy("sequence_id", "offset").collect()
    want = encoded([(1, words)])[1]
    assert [r.ids_crc32 for r in got if r.doc_id == 1] == [crc(want[a : a + cc.LENGTH]) for a in range(0, len(want), cc.LENGTH)]
