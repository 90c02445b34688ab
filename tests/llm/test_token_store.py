import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import token_store as ts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = ["İSTANBUL ÀÉ×÷ßÞþÿ", "!!!!!!!!!!!! a......... b,.;:x", "<|STARTOFTEXT|> A<|endoftext|>, x<Y É<", "x" * 20_000 + " é́ É́.", "don't DON'T I'LL it's. 'S", "Ａ Ⅷ ǆ ﬁ K Å", "", " \t\n", "ΣΑΣ. ΣΑΣ", "a\x1cb c\x85d e", "½ ² ٣ 四 abc123def", "foo_bar-baz's'll \x00 z", "﻿hi​there"]


@pytest.fixture(scope="module")
def encoder():
    return ts.WordEncoder(PATH, "<u2")


def plain(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_units_give_the_library_s_ids(encoder, documents):
    texts = [r.text or "" for r in documents.collect()] + ODD
    assert encoder.encode([t.encode() for t in texts]) == [plain(encoder, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAéÉ 'st.,!$\n<|>1"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_any_text(encoder, texts):
    assert encoder.encode([t.encode() for t in texts]) == [plain(encoder, t) for t in texts]


#: Unicode's white space: the library takes a lone one for a space, numpy's cut takes those beyond ASCII for a unit.
WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@pytest.mark.parametrize("first", WHITE)
def test_lone_white_space_with_a_fresh_cache(encoder, first):
    fresh = ts.WordEncoder.__new__(ts.WordEncoder)
    fresh.__dict__.update(encoder.__dict__)
    texts = [first, f"the {first} the", f"{first} the", f"the {first}"] + [f"zebra {first}{other} the {other} {first} a" for other in WHITE]
    for t in [*texts, " ".join(texts)]:
        fresh.known = ts.Known(fresh.dtype)  # whichever unit has the least key stands first among new ones
        assert fresh.encode([t.encode()]) == [plain(encoder, t)], ascii(t)


def test_a_small_cache_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(ts, "LIMIT", 300)
    small = ts.WordEncoder(PATH, "<u2")
    for t in [r.text or "" for r in documents.collect()]:
        assert small.encode([t.encode()]) == [plain(small, t)]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_round_trip_of_codes(values):
    v = np.array(values, np.uint32)
    control, data = ts.compress(v)
    assert len(control) == -(-len(v) // 4) and ts.expand(control, data, len(v)).tolist() == values


def brute(rows):
    tokenizer, at, out = tokenizers.Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_IDS", 500)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = ts.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_frequent_ids_take_a_byte(spark, documents, tmp_path):
    ts.write_store(documents, f"file://{tmp_path}/s", PATH)
    blocks = spark.read.parquet(f"file://{tmp_path}/s/blocks").selectExpr("sum(n) n", "sum(octet_length(data)) b", "sum(octet_length(control)) c").head()
    assert blocks.b < 1.6 * blocks.n and blocks.c <= blocks.n / 4 + 100


def test_odd_rows(spark, odd, empty):
    got = ts.digest(odd, PATH).collect()
    assert len(got) == odd.count() and sorted(r.start for r in got)[0] == 0
    order = sorted(got, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:], strict=False))
    assert [r.doc_id for r in order][:2] == [None, None]
    assert ts.digest(empty, PATH).count() == 0


def test_other_tokenizers_are_encoded_plainly(spark, documents, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    cased = public_tokenizers.path("byte_bpe_50k.json")
    definition = json.loads(open(PATH, encoding="utf-8").read())
    assert ts.is_word_bpe(definition) and not ts.is_word_bpe(json.loads(open(cased, encoding="utf-8").read()))
    definition["normalizer"]["normalizers"].pop()
    assert not ts.is_word_bpe(definition)
    docs = documents.select("doc_id", "text").limit(40)
    library = Tokenizer.from_file(cased)
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in ts.encoded(docs, cased).collect()}
    assert got == {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, ts.END_ID] for r in docs.collect()}
    with pytest.raises(ValueError, match="don't fit"):
        ts.fits(cased, "u1")
