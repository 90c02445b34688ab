"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: a histogram of pairs of
neighbouring byte classes and a few word statistics go through a learned layer. Gated attention
weighs the passages of a document, and the weighted passage representation gives its score. Only
documents have labels; encoder, attention and output are learned from them together, in numpy.

The classifier is fitted on SAMPLE labelled documents at most, of PASSAGES passages together, chosen by
a hash of their id, whole, and never on held-out rows (crc32 of the id as text divisible by 5). Labels, language, source and id are
no inputs. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import blobs, forget, lean, uniform, written

PASSAGE = 64
SAMPLE = 4000
#: Passages of all texts that training learns from together, whole texts of them, at most (77 MB); one text at least.
PASSAGES = 1 << 17
#: Files of the sample's measures.
BAG_FILES = 8
THRESHOLD = 0.3


def _classes() -> tuple[np.ndarray, int]:
    """The class of each byte: white space, letters by case, digits, marks by kind, other bytes."""
    groups = [b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:", b"!?", b"#$%&*", b"|<>", b"\"'()[]{}", b"-_/\\=+@^~`"]
    table = np.full(256, len(groups), np.int64)  # control characters
    table[128:] = len(groups) + 1
    for i, g in enumerate(groups):
        table[list(g)] = i
    return table, len(groups) + 2


TABLE, N_CLASSES = _classes()
EXTRA = 4
WIDTH = N_CLASSES * N_CLASSES + EXTRA


def passages(blob: bytes) -> np.ndarray:
    """A row of WIDTH measures for each passage; a text without words is one passage of zeros."""
    found = blob.split()
    if not found:
        return np.zeros((1, WIDTH), np.float32)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = -(-len(found) // PASSAGE)
    of = np.arange(len(found)) // PASSAGE
    size = np.bincount(of, minlength=n)
    again = np.bincount(of[1:], hashes[1:] == hashes[:-1], minlength=n) / size
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(found), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, minlength=n) / size
    mean = np.bincount(of, lengths, minlength=n) / size / 10
    pairs = np.zeros((n, N_CLASSES * N_CLASSES), np.float32)
    for first in range(0, n, 4096):  # whole passages, so that a long text needs no more memory
        last = min(n, first + 4096)
        words_here = found[first * PASSAGE : last * PASSAGE]
        raw = np.frombuffer(b" ".join(words_here), np.uint8)
        kinds = TABLE[raw]
        step = lengths[first * PASSAGE : last * PASSAGE] + 1
        begin = np.concatenate([[0], np.cumsum(np.add.reduceat(step, np.arange(0, len(step), PASSAGE)))])
        begin[-1] = len(raw)
        row = np.repeat(np.arange(last - first), np.diff(begin))
        cell = row[:-1] * (N_CLASSES * N_CLASSES) + kinds[:-1] * N_CLASSES + kinds[1:]
        got = np.bincount(cell, minlength=(last - first) * N_CLASSES * N_CLASSES).reshape(last - first, -1)
        pairs[first:last] = got / np.maximum(1, got.sum(axis=1, keepdims=True))
    extra = np.stack([again, distinct, mean, np.minimum(1, size / PASSAGE)], axis=1).astype(np.float32)
    return np.concatenate([pairs, extra], axis=1)


@dataclass
class Model:
    """Weights of encoder, gated attention and output, and the scale of the measures."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) * self.scale, -8, 8) @ self.w["e"] + self.w["eb"])

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each bag; bags are rows of x from a start to the next."""
        h = self.encode(x)
        gate = np.tanh(h @ self.w["v"]) / (1 + np.exp(-(h @ self.w["u"])))
        a = _softmax((gate @ self.w["a"])[:, 0], starts, len(x))
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ self.w["o"] + self.w["ob"], -30, 30)))[:, 0]


def _softmax(e: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    counts = np.diff(np.append(starts, n))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    return e / np.repeat(np.add.reduceat(e, starts), counts)


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 12, batch: int = 64, seed: int = 8) -> Model:
    """Learns a model by Adam on the log loss of document labels.

    Without labels, or with labels of one kind alone, the score is their share (0.5 without any).
    """
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / (spread + 1e-3), 0).astype(np.float32)
    shapes = {"e": (WIDTH, hidden), "eb": (1, hidden), "v": (hidden, gates), "u": (hidden, gates), "a": (gates, 1), "o": (hidden, 1), "ob": (1, 1)}
    w = {k: (np.zeros(s) if k.endswith("b") else rng.normal(0, s[0] ** -0.5, s)).astype(np.float32) for k, s in shapes.items()}
    share = float(labels.mean()) if len(labels) else 0.5
    model = Model(mean.astype(np.float32), scale, w)
    if share in (0.0, 1.0) or not len(labels):
        w["o"][:] = 0
        w["ob"][:] = 30 if share == 1 else -30 if share == 0 else 0
        return model
    w["ob"][:] = np.log(share / (1 - share))
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 3e-3 * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            counts = np.array([len(bags[i]) for i in some])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            xb = np.clip((np.concatenate([bags[i] for i in some]) - model.mean) * scale, -8, 8)
            y = labels[some].astype(np.float32)[:, None]
            grads = gradients(w, xb, starts, y)
            step += 1
            for k, grad in grads.items():
                grad = grad + 1e-4 * w[k] * (not k.endswith("b"))
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def gradients(w: dict[str, np.ndarray], xb: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of bags (rows of xb from a start to the next) with labels y, by each weight."""
    counts = np.diff(np.append(starts, len(xb)))
    h = np.tanh(xb @ w["e"] + w["eb"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    a = _softmax((t * g @ w["a"])[:, 0], starts, len(xb))[:, None]
    z = np.add.reduceat(a * h, starts, axis=0)
    d = (1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30))) - y) / len(starts)
    dz = np.repeat(d @ w["o"].T, counts, axis=0)
    da = (dz * h).sum(axis=1, keepdims=True)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts, axis=0), counts, axis=0))
    dgate = de @ w["a"].T
    dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
    dh = (a * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
    return {"e": xb.T @ dh, "eb": dh.sum(axis=0, keepdims=True), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "o": z.T @ d, "ob": d.sum(axis=0, keepdims=True)}


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The measures of all passages of each text, and how many there are."""
    for batch in batches:
        made = [passages(b) for b in blobs(batch.column(1))]
        sizes, bags = pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, bags], ["doc_id", "label", "size", "bag"])


def within(sizes: list[int], most: int) -> int:
    """How many of the first have ``most`` together at most, one at least where there is one."""
    return max(min(len(sizes), 1), int(np.searchsorted(np.cumsum(sizes), most, "right")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits a model on labelled documents that aren't held out, ``sample`` of them at most.

    The sample is the labels with the least hash of doc_id, as many of them as have PASSAGES passages
    together: fewer documents where texts are long, each of them whole. Only their measures come to the
    driver. Of rows that repeat an id the one with the least hash of its text is learned. Scores read
    every passage. Null labels are none; of several labels of an id the greatest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_llm_id")).agg(F.max(label).cast("long").alias("label"))
    order = uniform(F.col("_llm_id"), F.lit(8))
    chosen = known.orderBy(order, "_llm_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_llm_id")).select("doc_id", "text", "label")
    bagged = rows.mapInArrow(lean(_bags), "doc_id long, label long, size long, bag binary")
    one = written(bagged.groupBy("doc_id").agg(F.min_by(F.struct("label", "size", "bag"), F.xxhash64("bag")).alias("r")).select("doc_id", "r.*"), "labelled-passages", parts=BAG_FILES)
    sizes = one.select("doc_id", "size", uniform(F.col("doc_id"), F.lit(8)).alias("u")).toArrow().sort_by([("u", "ascending"), ("doc_id", "ascending")])
    learned = sizes["doc_id"].to_pylist()[: within(sizes["size"].to_pylist(), PASSAGES)]
    names = docs.sparkSession.createDataFrame([(i,) for i in learned], "doc_id long")
    got = one.join(F.broadcast(names), "doc_id").select("doc_id", "label", "bag").toArrow().sort_by([("doc_id", "ascending")])
    forget(one)
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["bag"].to_pylist()]
    return fit(bags, (got["label"].to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, 0 to 1: how likely label 1 is. A null text counts as empty.

    A column score that docs has already is replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("score")
    at, names = docs.columns.index(text_col), [*docs.columns, "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, bags, rows = [], [], 0
            found = blobs(batch.column(at))
            for k in range(batch.num_rows):
                bags.append(passages(next(found)))
                rows += len(bags[-1])
                if rows > 8192 or k == batch.num_rows - 1:
                    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
                    scores.append(sent.value.scores(np.concatenate(bags), starts))
                    bags, rows = [], 0
            made = np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names)

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted: 1 where the score is at least threshold, else 0.

    Every row is scored by its text alone: rows that repeat get the same score, ids may be null.
    """
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
