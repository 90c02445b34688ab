import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators import clustering, sampling


def round_robin(counts, size):
    """Quotas by taking turns; counts: (allocation_key, cluster_number, eligible)."""
    quota, order = {c: 0 for _, c, _ in counts}, sorted(counts)
    while size:
        moved = False
        for _, c, n in order:
            if size and quota[c] < n:
                quota[c], size, moved = quota[c] + 1, size - 1, True
        if not moved:
            break
    return quota


def test_quotas_are_the_round_robin(spark):
    rng = random.Random(7)
    for _ in range(12):
        counts = [(f"{rng.randrange(16**4):04x}", c, rng.randint(1, 12)) for c in range(rng.randint(1, 8))]
        rows = [(c, k, i % 3 == 0, i % 4 == 0) for k, c, n in counts for i in range(n)]
        size = rng.randint(1, len(rows))
        got = sampling.quotas(spark.createDataFrame(rows, "cluster_number int, allocation_key string, critical_priority_signal boolean, prior_failure_signal boolean"), size)
        assert {r.cluster_number: r.quota for r in got.collect()} == round_robin(counts, size), (counts, size)


def _assigned(spark):
    rows = [(f"t{i:02d}", i % 3, None if i == 0 else " " if i == 1 else f"r{i}", f"d{i}", f"s{i}") for i in range(20)]
    return spark.createDataFrame(rows, "trace_id string, cluster_number int, response string, document_hash string, source_trace_hash string")


def _signals(spark, *rows):
    return spark.createDataFrame(list(rows), "trace_id string, critical_priority_signal boolean, prior_failure_signal boolean")


def test_selection(spark):
    rows = sampling.eligible(_assigned(spark), _signals(spark, ("t05", True, True), ("t07", False, True)), "c", "m")
    assert rows.count() == 18
    got = sampling.select_sample(rows, 9).collect()
    assert len(got) == 9 and max(sum(r.cluster_number == c for r in got) for c in range(3)) == 3
    assert {"t05", "t07"} <= {r.trace_id for r in got} and next(r for r in got if r.trace_id == "t05").preference_tier == 0
    assert {r.trace_id for r in sampling.select_sample(rows.repartition(5), 9).collect()} == {r.trace_id for r in got}
    with pytest.raises(sampling.SamplingError):
        sampling.select_sample(rows, 19)
    labels = spark.createDataFrame([(c, None, None) for c in range(4)], "cluster_number int, label string, label_key string")
    manifest = {r.cluster_number: r for r in sampling.build_manifest(rows, 9, labels).collect()}
    assert [manifest[c].quota for c in range(4)] == [3, 3, 3, 0]


def test_history(spark):
    cases = spark.createDataFrame([("e1", "t1", "critical"), ("e2", "t2", "low"), ("e3", "t3", "low"), ("e4", "t4", "low")], "eval_id string, source_trace_id string, priority string")
    results = spark.createDataFrame([("r1", "e2", False), ("r2", "e3", False), ("r3", "e4", False), ("r1", "e1", True)], "run_id string, eval_id string, passed boolean")
    runs = spark.createDataFrame([("r1", "x1", "completed"), ("r2", "x2", "completed"), ("r3", "x1", "failed")], "run_id string, experiment_id string, status string")
    experiments = spark.createDataFrame([("x1", "completed"), ("x2", "failed")], "experiment_id string, status string")
    got = sorted(map(tuple, sampling.history_signals(cases, results, runs, experiments).collect()))
    assert got == [("t1", True, False), ("t2", False, True)]


def test_cases_leak_nothing(spark):
    sample = spark.createDataFrame([("a", "ra", 0, 1, 2), ("b", "rb", 0, 2, 2), ("c", "rc", 1, 1, 2)], "trace_id string, response string, cluster_number int, selection_rank int, preference_tier int")
    overrides = spark.createDataFrame([("a", "rubric", ["x"], None, "high", None), ("b", "deterministic", None, [("json_validity", "{}")], None, "approved")], "source_trace_id string, mode string, rubric array<string>, scorers array<struct<name:string,config:string>>, priority string, review_status string")
    rows = {r.source_trace_id: r for r in sampling.build_cases(sample, overrides, "dataset_x").collect()}
    assert (rows["a"].reference_answer, rows["a"].source_response, rows["a"].priority, rows["a"].review_status) == (None, None, "high", "draft")
    assert (rows["c"].evaluation_mode, rows["c"].reference_answer, rows["c"].priority) == ("reference", "rc", "medium")
    assert sampling.unused_overrides(overrides, sample.filter("trace_id != 'b'")).head()[0] == "b"


def test_terms_and_documents(spark):
    rows = spark.createDataFrame([("Élan vital, a x9!",), ("a",), ("",)], "t string").select(clustering.terms(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == [["elan", "vital", "x9", "elan vital", "vital x9"], [], []]
    got = spark.range(1).select(clustering.document_text(F.lit("p"), F.lit("{}")), clustering.document_text(F.lit("p"), F.lit('{"a":1}'))).head()
    assert tuple(got) == ("p", 'PROMPT:\np\nCONTEXT_JSON:\n{"a":1}')


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc")], "id int, text string")
    rows = {(r.id, r.term): r.weight for r in clustering.tfidf(docs, "id", "text").collect()}
    rare, shared = np.log(3 / 2) + 1, 1.0
    raw = {"aa": (1 + np.log(2)) * rare, "bb": shared, "aa aa": rare, "aa bb": rare}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert {t: rows[1, t] for t in raw} == pytest.approx({t: v / norm for t, v in raw.items()})
    assert clustering.distinct_vectors(clustering.tfidf(docs, "id", "text")) == 2


def test_numbers_and_indexes(spark):
    rows = spark.createDataFrame([("b", 9), ("a", 4), ("d", 9), ("c", 1)], "trace_id string, cluster int")
    assert {r.trace_id: r.cluster_number for r in clustering.canonical_numbers(rows).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    ids = spark.range(1000).selectExpr("cast(id as string) as trace_id").repartition(7)
    got = {r.trace_id: r.document_index for r in clustering.document_index(ids).collect()}
    assert got == {t: i for i, t in enumerate(sorted(got))}


def test_every_row_has_an_index_of_its_own(spark):
    """Wide rows over many ranges: none is lost, and indexes are contiguous in the order of ids."""
    n = 300_000
    rows = spark.range(n).select(F.concat(F.lit("t"), F.xxhash64("id")).alias("trace_id"), F.sha2(F.col("id").cast("string"), 256).alias("document_hash"), F.sha2(F.concat(F.lit("x"), "id"), 256).alias("source_trace_hash")).repartition(13)
    got = clustering.document_index(rows).withColumn("at", F.row_number().over(Window.orderBy("trace_id")) - 1)
    assert got.agg(F.count("*"), F.countDistinct("trace_id"), F.countDistinct("document_index"), F.min("document_index"), F.max("document_index"), F.count_if(F.col("at") != F.col("document_index"))).head() == (n, n, n, 0, n - 1, 0)
    assert clustering.document_index(rows.limit(0)).count() == 0


def test_clusters_of_documents(spark):
    """Sparse vectors, the decomposition and k-means find the groups that the texts were made in."""
    topics = ["refund the invoice amount", "reset my login password", "parcel shipping delivery date"]
    docs = spark.createDataFrame([(f"t{i:02d}", f"{topics[i % 3]} number{i} {topics[i % 3]}") for i in range(30)] + [("t99", "")], "trace_id string, document string")
    vectors, terms = clustering.sparse_vectors(clustering.tfidf(docs, "trace_id", "document"), docs.select(F.col("trace_id").alias("id")))
    assert clustering.distinct(vectors) == 31
    for components in (None, 3):
        rows = clustering.decomposed(vectors, terms, components)[0] if components else vectors
        made, cost = clustering.kmeans(rows, 3, 6, width=components or terms)
        got = {r.id: r.cluster for r in made.collect()}
        assert len(got) == 31 and cost >= 0 and len(set(got.values())) == 3
        assert all(len({got[f"t{i:02d}"] for i in range(k, 30, 3)}) == 1 for k in range(3))
