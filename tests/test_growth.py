"""What keeps steps small where tables are large."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import clustering
from assayer.operators import vectors as V


def _matrix(rows, width):
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, r.at] = r.x
    return out


def test_terms_of_one_document_are_one_component(spark):
    """Words that only one document has don't widen the centers of k-means; products of documents stay."""
    texts = [f"common {'left' if i % 2 else 'right'} " + " ".join(f"own{i}x{j}" for j in range(40)) for i in range(30)] + ["common left", "", "right right"]
    docs = spark.createDataFrame([(f"t{i:02}", t) for i, t in enumerate(texts)], "trace_id string, document string")
    weights = clustering.tfidf(docs, "trace_id", "document").cache()
    made, terms = clustering.sparse_vectors(weights, docs.select(F.col("trace_id").alias("id")))
    rows = made.orderBy("id").collect()
    width = max(max(r.at, default=-1) for r in rows) + 1
    assert terms == weights.select("term").distinct().count() and width <= 5 + len(texts)
    places = {t: i for i, t in enumerate(sorted({r.term for r in weights.collect()}))}
    whole = np.zeros((len(texts), len(places)))
    for r in weights.collect():
        whole[int(r.id[1:]), places[r.term]] = r.weight
    held = _matrix(rows, width)
    assert np.allclose(held @ held.T, whole @ whole.T, atol=1e-12)
    assert V.KMeans(made, 2, width=terms).settled == pytest.approx(1e-4 * whole.var(axis=0).mean(), rel=1e-6)
    weights.unpersist()


def test_all_starts_share_the_passes_of_wide_rows(spark):
    rows = [(i, [i % 2, 200_000 + i], [1.0, 0.25]) for i in range(40)]
    km = V.KMeans(V.stored_vectors(spark.createDataFrame(rows, "id long, at array<int>, x array<double>"), "at"), 2)
    labels = {r.id: r.cluster for r in km.fit()[0].collect()}
    assert all(labels[i] == labels[i % 2] for i in range(40)) and labels[0] != labels[1]
    assert km.passes < 20


@pytest.mark.parametrize("width", [3, 64])
def test_dense_sums_are_those_of_whole_numbers(width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(500, width)) * 1000
    block = V.Block(None, np.arange(500), np.arange(501) * width, np.tile(np.arange(width), 500), x.reshape(-1), width)
    whole = np.rint(x * 2.0**40).astype(np.int64)
    cells = rng.integers(4, size=(500, 3)) + np.arange(3) * 4
    got, want = np.zeros(12 * width, np.int64), np.zeros((12, width), np.int64)
    block.summed(cells, 12, whole.reshape(-1), got)
    for c in cells.T:
        np.add.at(want, c, whole)
    assert (got.reshape(12, width) == want).all()


@pytest.mark.parametrize("sparse", [False, True])
def test_directions_are_lists_of_the_fewer_numbers(spark, monkeypatch, sparse):
    """Fewer rows than components: the driver holds numbers by rows, and what comes out is the same."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random((40, 900)) < 0.1, rng.random((40, 900)), 0)
    x[7] = 0
    rows = [(f"i{i:02}", np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) if sparse else (f"i{i:02}", None, v.tolist()) for i, v in enumerate(x)]
    vectors = V.stored_vectors(spark.createDataFrame(rows, "id string, at array<int>, x array<double>").repartition(3), "at" if sparse else None)
    sizes, product = [], V._times_transposed
    monkeypatch.setattr(V, "_times_transposed", lambda rows, q: sizes.append(len(q)) or product(rows, q))
    made, values = V.decomposed(vectors, 900, 5)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert set(sizes) == {40} and values == pytest.approx(s[:5], rel=1e-9)
    got = np.array([r.x for r in made.orderBy("id").collect()])
    want = u[:, :5] * s[:5]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    want[7] = 0
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-6) and (got[7] == 0).all()


def test_vectors_of_one_file_are_dealt_to_all_cores(spark):
    rows = V.stored_vectors(spark.range(9000).coalesce(1).select("id", F.array(F.col("id") % 7, F.col("id") % 5).alias("x")))
    blocks = V.packed(rows)
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(len(b) for b in V.unpacked([blocks.toArrow().combine_chunks().to_batches()[0]])) == 9000
