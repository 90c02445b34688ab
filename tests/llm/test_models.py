import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import lm_scoring as lm
from assayer.llm import quality_classifier as qc


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "of", "wood", "stands", "near", "a", "river", "and", "birds", "sing"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def labeled(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(700):
        words = prose(rng, rng.randint(20, 300))
        quality = int(rng.random() > 0.3)
        if not quality:  # one bad passage among good ones
            bad = rng.choice([prose(rng, 70).upper().replace(" ", "!! "), prose(rng, 70).replace(" ", "$$$ "), "word " * 70])
            words = words + " " + bad + " " + prose(rng, 40)
        rows.append((i, words))
        labels.append((i, quality, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(labeled):
    docs, labels = labeled
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = qc.digest(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_and_other_columns_change_nothing(labeled):
    docs, labels = labeled
    turned = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qc.digest(docs.withColumn("lang", F.lit("x")), x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_training_is_bounded(labeled, monkeypatch):
    """Whole texts, as many as have PASSAGES passages together; a labelled id that repeats is learned once."""
    docs, labels = labeled
    seen = []
    monkeypatch.setattr(qc, "fit", lambda bags, y: seen.append(([len(b) for b in bags], len(y))))
    long = docs.filter("doc_id = 1 or doc_id = 2").withColumn("text", F.repeat("text", 50))
    more = docs.filter("doc_id not in (1, 2)").unionByName(docs.filter("doc_id = 3")).unionByName(long)
    known = labels.filter(~qc.held_out(F.col("doc_id"))).count()
    qc.train(more, labels)
    sizes, n = seen.pop()
    assert n == len(sizes) == known and max(sizes) > 20  # the long texts are whole
    monkeypatch.setattr(qc, "PASSAGES", 30)
    qc.train(more, labels)
    fewer, n = seen.pop()
    assert 0 < n == len(fewer) < known and (sum(fewer) <= 30 or n == 1) and set(fewer) <= set(sizes)
    assert [qc.within(x, 10) for x in ([], [50], [4, 6, 1], [4, 7], [0, 0])] == [0, 1, 2, 1, 2]


def plain_score(model, bag):
    """A bag's score by the formulas, number by number."""
    w = {k: v.astype(float).tolist() for k, v in model.w.items()}
    hidden, gates = range(len(w["eb"][0])), range(len(w["a"]))
    encoded = []
    for row in bag.tolist():
        x = [min(8.0, max(-8.0, (v - m) * s)) for v, m, s in zip(row, model.mean.tolist(), model.scale.tolist(), strict=True)]
        encoded.append([math.tanh(sum(v * w["e"][i][j] for i, v in enumerate(x)) + w["eb"][0][j]) for j in hidden])
    gate = lambda h, k: math.tanh(sum(h[j] * w["v"][j][k] for j in hidden)) / (1 + math.exp(-sum(h[j] * w["u"][j][k] for j in hidden)))
    energy = [math.exp(sum(gate(h, k) * w["a"][k][0] for k in gates)) for h in encoded]
    z = [sum(e * h[j] for e, h in zip(energy, encoded, strict=True)) / sum(energy) for j in hidden]
    return 1 / (1 + math.exp(-(sum(v * w["o"][j][0] for j, v in enumerate(z)) + w["ob"][0][0])))


def small_model(rng, width=6):
    shapes = {"e": (width, 5), "eb": (1, 5), "v": (5, 4), "u": (5, 4), "a": (4, 1), "o": (5, 1), "ob": (1, 1)}
    return qc.Model(rng.normal(size=width), rng.random(width) + 0.5, {k: rng.normal(size=s) for k, s in shapes.items()})


def test_scores_against_the_formulas(labeled):
    rng = np.random.default_rng(3)
    model = small_model(rng)
    bags = [rng.normal(size=(n, 6)) for n in (1, 4, 2, 7)]
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    assert model.scores(np.concatenate(bags), starts).tolist() == pytest.approx([plain_score(model, b) for b in bags], abs=1e-12)
    docs, labels = labeled
    model = qc.train(docs, labels)  # a trained one, over whole texts
    some = docs.orderBy("doc_id").limit(5)
    got = {r.doc_id: r.score for r in qc.score(some, model).collect()}
    assert got == pytest.approx({r.doc_id: plain_score(model, qc.passages((r.text or "").encode())) for r in some.collect()}, abs=1e-4)


def test_gradients_of_all_weights_against_differences():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    bags = [rng.normal(size=(n, 6)) for n in (3, 1, 5)]
    x, starts, y = np.concatenate(bags), np.array([0, 3, 4]), np.array([[1.0], [0.0], [1.0]])
    plain = qc.Model(np.zeros(6), np.ones(6), model.w)

    def loss():
        p = plain.scores(x, starts)[:, None]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    found = qc.gradients(model.w, x, starts, y)
    for name, weights in model.w.items():
        for at in np.ndindex(weights.shape):
            held = weights[at]
            weights[at] = held + 1e-6
            above = loss()
            weights[at] = held - 1e-6
            below = loss()
            weights[at] = held
            assert found[name][at] == pytest.approx((above - below) / 2e-6, abs=1e-7), (name, at)


def test_attention_weighs_passages():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(1, 9), qc.WIDTH)).astype(np.float32)
        y.append(i % 2)
        if not y[-1]:
            bag[rng.integers(len(bag)), :5] += 4
        bags.append(bag)
    model = qc.fit(bags, np.array(y, np.float32))
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    scores = model.scores(np.concatenate(bags), starts)
    assert ((scores > 0.5) == np.array(y)).mean() > 0.95
    one = [model.scores(b, np.array([0]))[0] for b in bags[:20]]
    assert np.allclose(one, scores[:20], atol=1e-5)


def test_classifier_odd_rows(labeled, odd, empty):
    _, labels = labeled
    got = qc.digest(odd, labels).collect()
    assert len(got) == odd.count() and all(r.score is not None for r in got)
    assert qc.digest(empty, labels).count() == 0
    assert {r.score for r in qc.digest(odd, labels.limit(0)).collect()} == {0.5}
    one = labels.withColumn("quality", F.lit(1))
    assert {r.predicted for r in qc.digest(odd, one).collect()} <= {1}
    clash = qc.classify(odd.withColumnRenamed("size", "score"), labels.withColumn("quality", F.lit(None).cast("int")))
    assert clash.columns.count("score") == 1 and clash.count() == odd.count()
    long = qc.passages(b"word " * 400_000)
    assert long.shape == (6250, qc.WIDTH) and np.isfinite(long).all()


SIZE = 4 * lm.CLASSES


def plain_log_probability(w, y, before_and_after):
    """One token in its context, by loops over every token of the vocabulary."""
    h = np.array(w["b"][0], np.float64)
    for j, c in enumerate(before_and_after):
        h = h + w["e"][c].astype(np.float64) * w["c"][j]
    h = np.tanh(h)
    inside = len(w["e"]) // 1024

    def level(weights, place):
        logits = [sum(h[i] * row[i] for i in range(16)) + row[16] for row in weights]
        return logits[place] - np.log(sum(np.exp(x) for x in logits))

    cls = y // inside
    first = level(w["g"], cls // 32)
    second = level(w["t"][cls // 32].reshape(32, 17), cls % 32)
    return first + second + level(w["u"][cls].reshape(inside, 17), y % inside)


def noisy(size, seed=3):
    rng = np.random.default_rng(seed)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm.fresh(size).items()}


def test_gradients_against_differences():
    rng, w = np.random.default_rng(5), noisy(SIZE)
    y, c = lm.windows([rng.integers(0, 60, 40).astype(np.uint32) for _ in range(3)], SIZE - 1)
    loss = lambda v: -np.mean([plain_log_probability(v, int(t), c[:, i].tolist()) for i, t in enumerate(y)])
    trainer = lm.Trainer(w, rate=0.0)
    for v in trainer.squares.values():
        v[:] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        trainer.step(y, c)  # squares are now the squared gradient times n
    for name in w:
        size = np.sqrt(trainer.squares[name] / len(y)).ravel()
        for k in rng.choice(np.flatnonzero(size >= size.max() / 4), 2):
            up, down = ({n: v.astype(np.float64) for n, v in w.items()} for _ in range(2))
            up[name].reshape(-1)[k] += 1e-3
            down[name].reshape(-1)[k] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3) == pytest.approx(size[k], rel=0.02, abs=1e-4), name


@pytest.mark.parametrize("size", [lm.CLASSES, SIZE])
def test_probabilities_sum_to_one(size):
    w = noisy(size)
    every = np.arange(size).astype(np.uint32)
    context = np.repeat(np.array([[1], [2], [7], [size - 1]], np.uint32), size, axis=1)
    logs = lm.log_probabilities(w, every, context, 999)
    assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)
    for t in (0, 5, size // 2, size - 1):
        assert logs[t] == pytest.approx(plain_log_probability(w, t, [1, 2, 7, size - 1]), abs=1e-4)


def test_both_sides_are_used():
    y, c = lm.windows([np.array([1, 2, 3, 4, 5], np.uint32), np.zeros(0, np.uint32), np.array([6], np.uint32)], 99)
    assert y.tolist() == [1, 2, 3, 4, 5, 6]
    assert c[:, 2].tolist() == [1, 2, 4, 5] and set(c[:, 5].tolist()) == {99}


def test_each_place_is_looked_up_once(monkeypatch):
    """Training and scoring along a line give what they give window by window."""
    rng, w = np.random.default_rng(8), noisy(SIZE)
    seqs = [rng.integers(0, 90, n).astype(np.uint32) for n in (50, 0, 1, 2, 33)]
    (line, at), (y, c) = lm.laid(seqs, SIZE - 1), lm.windows(seqs, SIZE - 1)
    assert line[at].tolist() == y.tolist()
    assert lm.log_probabilities_along(w, line, at, 20) == pytest.approx(lm.log_probabilities(w, y, c, 999), abs=1e-5)
    along, one = lm.Trainer(w), lm.Trainer(w)
    for a in range(0, len(at), 30):
        along.learn(line, at[a : a + 30])
        one.step(y[a : a + 30], c[:, a : a + 30])
    for name in w:
        assert along.w[name] == pytest.approx(one.w[name], abs=1e-4) and (along.weights(name) == one.weights(name)).all()
    assert along.seen["e"].sum() == c.size
    sizes, take = [], np.take
    monkeypatch.setattr(lm.np, "take", lambda x, i, **k: sizes.append(len(i)) or take(x, i, **k))
    lm.Trainer(w).learn(line, at)
    assert sizes[0] == len(line)  # not four times as many
    # beyond the bound of what needs no shift
    big = {k: v * 100 for k, v in w.items()}
    assert lm._bounds(big, "g", lm.GROUPS)[0] > lm.UNSHIFTED and not np.isnan(lm.log_probabilities_along(big, line, at)).any()


def test_the_vocabulary_grows_with_the_corpus():
    sizes = [lm.size_for(n) for n in (0, 10**4, 10**6, 10**8, 10**10, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == lm.LEAST and sizes[3] == 32768 and sizes[-1] == lm.MOST
    assert all(n & (n - 1) == 0 for n in sizes)


def test_scores_prefer_text_like_the_corpus(spark):
    rng = random.Random(1)
    sentences = ["the old house stands near the river", "birds sing in the tall green trees", "a small boat drifts along the shore"]
    rows = [(i, " . ".join(rng.choice(sentences) for _ in range(40))) for i in range(240)]
    mixed = " . ".join(sentences * 10).split()
    rng.shuffle(mixed)
    rows += [(1000, " . ".join(sentences * 10)), (1001, " ".join(mixed)), (1002, ""), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r for r in lm.digest(docs).collect()}
    assert got[1000].mean_log_probability > got[1001].mean_log_probability + 0.5
    assert (got[1002].n_tokens, got[1002].log_probability, got[1002].mean_log_probability) == (0, 0.0, None) and got[1003].n_tokens == 0
    assert all(r.n_tokens == len((t or "").split()) for i, t in rows for r in [got[i]])


def counted(docs):
    from collections import Counter

    return Counter(h for r in docs.collect() for h in lm.hashed((r.text or "").encode()).tolist())


def test_vocabulary_counts_everything(documents):
    counts = counted(documents)
    vocab = lm.vocabulary(lm.word_counts(documents))
    first = vocab.known[np.argsort(vocab.token)].tolist()
    assert sorted((counts[h] for h in first[:50]), reverse=True) == [n for _, n in counts.most_common(50)]
    small = lm.vocabulary(lm.word_counts(documents), 128)
    assert 60 < len(small.known) <= small.own and small.tokens == sum(counts.values())
    rest = {h: n for h, n in counts.items() if h not in set(small.known.tolist())}
    assert max(rest.values()) <= min(counts[h] for h in small.known.tolist())
    for t in range(small.shared):
        mine = [n for h, n in rest.items() if h % small.shared == t]
        assert (small.distinct[t], small.total[t]) == (len(mine), sum(mine))


def test_scores_against_brute_force(documents):
    """Every document's score, from the trained weights and counts of the words of all other documents."""
    from collections import Counter

    docs = documents.select("doc_id", "text")
    counts = lm.word_counts(docs)
    vocab = lm.vocabulary(counts, lm.CLASSES)
    vocab = lm.vocabulary(counts, 2048) if not vocab.shared else vocab
    small = lm.vocabulary(counts, 256)  # few words of their own
    vocab.known, vocab.token, vocab.total, vocab.distinct = (getattr(small, k) for k in ("known", "token", "total", "distinct"))
    vocab.shared, vocab.own = small.shared, vocab.size - small.shared - 1
    coded = lm.encoded(docs, vocab)
    w = lm.train(coded, vocab.size, vocab.tokens)
    got = {r.doc_id: r for r in lm.score(coded, counts, vocab, w).collect()}
    everywhere = counted(docs)
    for r in documents.collect()[::7]:
        words = lm.hashed((r.text or "").encode()).tolist()
        if len(words) > 500:
            continue
        mine = Counter(words)
        y, c = lm.windows([vocab.code(np.array(words, np.uint64))], vocab.outside) if words else ([], None)
        want, novel = 0.0, 0
        for i, t in enumerate(y):
            want += float(lm.log_probabilities(w, y[i : i + 1], c[:, i : i + 1])[0])
            if t >= vocab.own:
                other = everywhere[words[i]] - mine[words[i]]
                novel += other == 0
                k = t - vocab.own
                want += np.log((other + lm.UNSEEN) / (vocab.total[k] + lm.UNSEEN * vocab.distinct[k]))
        assert got[r.doc_id].n_tokens == len(words) and got[r.doc_id].n_novel == novel
        assert got[r.doc_id].log_probability == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert len(got) == documents.count()


def test_scoring_odd_rows(odd, empty):
    assert lm.digest(odd).count() == odd.count()
    assert lm.digest(empty).count() == 0


def test_documents_that_occur_twice_are_told_apart(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefgh") if rng.random() < 0.8 else f"w{rng.randrange(10**6)}" for _ in range(120))
    once, twice = [text() for _ in range(150)], [text() for _ in range(50)]
    filler = " ".join(f"f{i} f{i}" for i in range(3000))  # fills the vocabulary
    rows = [(i, t) for i, t in enumerate([*once, *twice, *twice, filler, filler])]
    got = {r.doc_id: r for r in lm.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i].n_novel > 0 for i in range(150)) and all(got[i].n_novel == 0 for i in range(150, 250))
    mean = lambda ids: np.mean([got[i].mean_log_probability for i in ids])
    assert mean(range(150, 250)) > mean(range(150)) + 0.1


def test_partitions_change_no_score(spark):
    """8 or 64 partitions, with several learners a round: the same model but for rounding."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[: 20 + i]) for _ in range(100))) for i in range(300)], "doc_id long, text string")
    vocab = lm.vocabulary(lm.word_counts(docs))
    few, many = (lm.train(lm.encoded(docs.repartition(n), vocab), vocab.size, vocab.tokens, learner=2000) for n in (8, 64))
    assert max(np.abs(few[k] - many[k]).max() for k in few) < 1e-3
    a, b = ({r.doc_id: r.log_probability for r in lm.digest(docs.repartition(n)).collect()} for n in (8, 64))
    assert a == pytest.approx(b, rel=1e-4)


def test_rows_are_averaged_by_their_own_windows(spark):
    """A word that one learner saw keeps what that learner learned, whatever the others' sizes."""
    kind, size = "block int, weights binary, model binary", lm.CLASSES
    blocks = lm._blocks(size)
    i = next(i for i, (name, a, z) in enumerate(blocks) if name == "e" and a <= 7 < z)
    name, a, z = blocks[i]
    rows = []
    for value, n in ((2.0, 0), (3.0, 5), (9.0, 1)):
        weights = np.zeros(z - a, np.int64)
        weights[7 - a] = n
        rows.append((i, bytearray(weights.tobytes()), bytearray(np.full((z - a, lm.WIDTH), value, np.float32).tobytes())))
    got = spark.createDataFrame(rows, kind).coalesce(1).mapInArrow(lm._average(size), kind).head()
    assert np.frombuffer(bytes(got.weights), np.int64)[7 - a] == 6
    assert np.allclose(np.frombuffer(bytes(got.model), np.float32).reshape(z - a, -1)[7 - a], 4.0)
