import random
from collections import Counter, defaultdict

import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import mixing, packing, quality_classifier, queries

from .test_near_dup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, path = random.Random(9), tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(360):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        quality = int(i % 6 != 5)
        text = " ".join(words if quality else [w.upper() + "!!" for w in words])
        if i % 10 == 1:
            text = rows[rng.randrange(len(rows))][1].swapcase() if i % 20 == 1 else rows[rng.randrange(len(rows))][1]
        if i % 10 == 2:
            held = rows[i - 2][1].split()
            held[len(held) // 2] = "changed"
            text = " ".join(held)
        rows.append((i, text, "en", None if i % 9 == 0 else f"s{i % 4}", len(text)))
        if i % 10 not in (1, 2):
            labels.append((i, quality, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: model.scores(quality_classifier.passages(r.text.encode()), __import__("numpy").array([0]))[0] for r in docs.collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.3)
    assert 0.7 < kept.count() / docs.count() < 0.95

    single = corpus_pipeline.drop_copies(spark, kept, sf_dir)
    groups = defaultdict(list)
    for r in kept.collect():
        groups[r.text.encode().lower()].append(r.doc_id)
    assert single.columns == COLUMNS and sorted(r.doc_id for r in single.collect()) == sorted(map(max, groups.values()))
    assert single.count() < kept.count()

    apart = corpus_pipeline.drop_near_copies(spark, single, sf_dir)
    want = [d for d, _, _, stays in brute([(r.doc_id, r.text) for r in single.collect()], 5) if stays]
    assert apart.columns == COLUMNS and sorted(r.doc_id for r in apart.collect()) == sorted(want)
    assert apart.count() < single.count()

    mixed = corpus_pipeline.mix_sources(spark, apart, sf_dir)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(apart).collect()}
    assert mixed.columns == COLUMNS and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})

    packed = corpus_pipeline.pack_sequences(spark, mixed, sf_dir).collect()
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    counted = Counter()
    for r in packed:
        counted[r.doc_id] += r.n_tokens
    assert counted == tokens
    held = defaultdict(int)
    for r in packed:
        held[r.sequence_id] += r.n_tokens
    assert all(held[r.sequence_id] <= r.capacity and r.capacity in packing.CAPACITIES for r in packed)

    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(Counter((r.doc_id, r.n_tokens) for r in whole.collect()).items()) == sorted(Counter((r.doc_id, r.n_tokens) for r in packed).items())


def test_shuffled_anti_join_gives_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == want


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size string, target string, position long, group_size long"


def test_stages_take_odd_tables(spark, sf_dir):
    """Null and repeated ids, repeated rows, near copies among them, empty texts, clashing columns: exact rows of every stage."""
    base = [f"word{i}" for i in range(60)]
    near = " ".join([*base[:30], "other", *base[31:]])
    texts = [(1, " ".join(base)), (None, near), (None, near.upper()), (2, "alone " * 9), (2, " ".join(f"else{i}" for i in range(40))), (3, None), (3, ""), (None, " "), (4, "alone " * 9), (4, "alone " * 9)]
    docs = spark.createDataFrame([(i, t, "en", None, 7, 0.5, None, "mine", "t", 9, 3) for i, t in texts], CLASH)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    single = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert single.columns == docs.columns
    assert rows(single) == sorted([(1, texts[0][1]), texts[4], (4, "alone " * 9), (None, " ")] + [(3, t) for t in (None,)] + [(None, min(near, near.upper()))], key=repr)
    apart = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert apart.columns == docs.columns
    got = rows(apart)
    assert len(got) == 6 and sum(t is not None and "word3 " in t.lower() for _, t in got) == 1 and sum(not (t or "").strip() for _, t in got) == 3
    assert texts[4] in got and sum((t or "").startswith("alone") for _, t in got) == 1
    assert texts[0] in got and texts[3] in got  # the least id of each group, whatever ids repeat or are missing elsewhere
    names = [r[0] for r in spark.createDataFrame([(5, "a"), (-3, "z"), (None, "a"), (2**62, None), (5, "b"), (0, "")], "i long, t string").orderBy(corpus_pipeline.row_name(F.col("i"), F.col("t"))).select("i").collect()]
    assert names == [-3, 0, 5, 5, 2**62, None]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {(r.score, r["size"], r.target, r.position, r.group_size) for r in mixed.collect()} == {(0.5, "mine", "t", 9, 3)}
    assert Counter(rows(mixed)) == Counter(rows(docs))  # one source: every document once
    kept = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.filter("score != 0.5").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()
    assert len(packed) == len(texts) and min(r.n_tokens for r in packed) == 1


def test_stages_take_empty_tables(spark, sf_dir, empty):
    docs = empty.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and len(corpus_pipeline.STAGES) == 5
