import pytest
from pyspark.sql import functions as F

from assayer.operators import comparing
from assayer.operators.comparing import ComparisonError, Limits
from assayer.plans import constraints, reports

# (slice, mode, baseline score, candidate score); a case passes from 0.7 on
SHOWCASE = [(s, m, 1.0, 1.0) for s in range(7) for m in ("deterministic", "reference", "rubric")]
CHANGES = {(1, "deterministic"): (1.0, 0.0), (2, "rubric"): (1.0, 0.5), (3, "rubric"): (0.6, 1.0), (4, "rubric"): (1.0, 0.4), (6, "deterministic"): (0.0, 1.0)}
LABELS = {0: "account-security", 1: "billing-invoices", 2: "cancellation-retention", 3: "delivery-tracking", 4: "refund-policy", 5: "returns-exchanges", 6: "product-troubleshooting"}


@pytest.fixture(scope="module")
def showcase(spark):
    rows = []
    for s, m, b, c in SHOWCASE:
        b, c = CHANGES.get((s, m), (b, c))
        for role, score in (("baseline", b), ("candidate", c)):
            rows.append((role, f"e{s}-{m}", m, s, f"cluster-{s}", LABELS[s], score, score >= 0.7))
    return spark.createDataFrame(rows, "role string, eval_id string, evaluation_mode string, cluster_number int, selector string, label_snapshot string, score double, passed boolean")


def test_showcase_aggregates(showcase):
    members = showcase.select("eval_id", "cluster_number", "selector", "label_snapshot").distinct()
    results = showcase.select("role", "eval_id", "evaluation_mode", "score", "passed")
    cases = comparing.compare_cases(results)
    scopes = {r.scope: r for r in comparing.comparison_aggregates(cases).collect()}
    want = {"global": (21, 0.933333, 0.9, -0.033333, 2, 3), "deterministic": (7, 0.857143, 0.857143, 0, 1, 1), "reference": (7, 1, 1, 0, 0, 0), "rubric": (7, 0.942857, 0.842857, -0.1, 1, 2)}
    for scope, w in want.items():
        r = scopes[scope]
        assert (r.case_count, *(round(x, 6) for x in (r.baseline_score, r.candidate_score, r.score_delta)), r.newly_passed_count, r.newly_failed_count) == pytest.approx(w)
    slices = {r.cluster_number: round(r.score_delta, 6) for r in comparing.comparison_slices(cases, members).collect()}
    assert slices == {0: 0, 1: -0.333333, 2: -0.166667, 3: 0.133333, 4: -0.2, 5: 0, 6: 0.333333}
    runs = {(r.role, r.scope): (r.passed_count, r.failed_count) for r in comparing.run_aggregates(results).collect()}
    assert runs["baseline", "global"] == (19, 2) and runs["candidate", "global"] == (18, 3)
    by_slice = {(r.role, r.cluster_number): r.pass_rate for r in comparing.run_slice_aggregates(results, members).collect()}
    assert by_slice["candidate", 6] == 1.0 and by_slice["candidate", 1] == pytest.approx(2 / 3)

    limits = comparing.effective_limits(Limits(0.02, 2), {"reference": Limits(0.0, 0), "deterministic": Limits(0.0, 0), "rubric": Limits(0.05, 1)})
    own = comparing.slice_limits({"refund-policy": Limits(0.0, 0), "Account-Security": Limits(0.0, 0)}, list(LABELS.items()))
    table = comparing.comparison_slices(cases, members)
    found = comparing.gate_violations(comparing.comparison_aggregates(cases), limits, table, own)
    rows = found.orderBy("violation_index").collect()
    assert [(r.scope, r.metric, r.scope_kind) for r in rows] == [("global", "score_drop", "global"), ("global", "new_failures", "global"), ("deterministic", "new_failures", "mode"), ("rubric", "score_drop", "mode"), ("rubric", "new_failures", "mode"), ("cluster-4", "score_drop", "slice"), ("cluster-4", "new_failures", "slice")]
    assert rows[0].message == "global score drop 0.033333 exceeds 0.020000" and rows[1].message == "global newly failed count 3 exceeds 2"
    assert comparing.verdict(found).head().verdict == "FAIL"
    status = {r.selector: r.gate_status for r in reports.slice_table(table, ["refund-policy", "cluster-0"], found).collect()}
    assert (status["cluster-4"], status["cluster-0"], status["cluster-1"]) == ("FAIL", "PASS", "Not configured")


def test_sums_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("baseline", f"e{i}", "reference", 0.1, True) for i in range(10)], "role string, eval_id string, evaluation_mode string, score double, passed boolean")
    assert {r.score for r in comparing.run_aggregates(rows).collect()} == {0.1}


def _scopes(spark, delta, failed):
    return spark.createDataFrame([(s, delta, failed) for s in ("global", "deterministic")], "scope string, score_delta double, newly_failed_count long")


def test_reaching_a_limit_is_allowed(spark):
    rows = _scopes(spark, -0.5, 1)
    assert comparing.gate_violations(rows, {"global": Limits(0.5, 1), "deterministic": Limits(1.0, 1)}).count() == 0
    found = comparing.gate_violations(rows, {"global": Limits(0.49, 0)}).orderBy("violation_index").collect()
    assert [(r.metric, r.scope_kind) for r in found] == [("score_drop", None), ("new_failures", None)]


def test_limits_fall_back_by_field():
    got = comparing.effective_limits(Limits(0.1, 4), {"rubric": Limits(None, 0), "reference": Limits(0.3, None)})
    assert list(got.items()) == [("global", Limits(0.1, 4)), ("reference", Limits(0.3, 4)), ("rubric", Limits(0.1, 0))]
    assert comparing.effective_limits(Limits(), {}) == {"global": Limits(0.0, 0)}


def test_selectors():
    slices = [(0, None), (1, "cluster-0"), (2, "Refunds")]
    assert comparing.resolve_selector(" REFUNDS ", slices) == 2
    for selector, match in (("cluster-0", "ambiguous"), ("none", "no cases")):
        with pytest.raises(ComparisonError, match=match):
            comparing.resolve_selector(selector, slices)
    with pytest.raises(ComparisonError, match="several"):
        comparing.slice_limits({"cluster-2": Limits(), "refunds": Limits()}, slices)


def test_gaps(showcase):
    assert comparing.coverage_gaps(showcase).count() == 0
    missing = showcase.filter("not (role = 'candidate' and cluster_number = 0)").withColumn("evaluation_mode", F.when((F.col("role") == "baseline") & (F.col("cluster_number") == 1), "x").otherwise(F.col("evaluation_mode")))
    assert comparing.coverage_gaps(missing).count() == 6


def test_latency(spark):
    rows = spark.createDataFrame([(r, float(i + d)) for r, d in (("baseline", 1), ("candidate", 3)) for i in range(21)] + [("baseline", -1.0), ("candidate", float("nan")), ("candidate", float("inf"))], "role string, latency_ms double")
    got = reports.latency(rows).head()
    assert (got.available, got.baseline_mean_ms, got.candidate_mean_ms, got.delta_ms) == (True, 11.0, 13.0, 2.0)
    assert not reports.latency(rows, ["baseline"]).head().available and not reports.latency(rows.limit(1)).head().available


def test_integrity_of_stored_rows(spark):
    frame = spark.createDataFrame
    members = frame([("a", 0), ("b", 0), ("c", 1)], "eval_id string, cluster_number int")
    counts = frame([(0, 2), (1, 2), (2, 0)], "cluster_number int, case_count long")
    assert [r.cluster_number for r in constraints.slice_membership(counts, members).collect()] == [1]
    violations = frame([("global", "global"), ("rubric", "mode"), ("reference", "mode"), ("cluster-1", "slice"), ("cluster-1", "mode"), ("x", "global")], "scope string, scope_kind string")
    bad = constraints.violation_scopes(violations, frame([("rubric",)], "evaluation_mode string"), frame([("cluster-1",)], "selector string"))
    assert sorted(map(tuple, bad.collect())) == [("cluster-1", "mode"), ("reference", "mode"), ("x", "global")]
    judged = frame([("r", "a", "critical", False, ["critical_failure"]), ("r", "b", "critical", False, []), ("r", "c", "low", True, []), ("r", "d", "low", True, [])], "run_id string, eval_id string, priority string, passed boolean, review_reasons array<string>")
    lookups = frame([("r", "a", "k1", "hit"), ("r", "b", "k1", "hit"), ("r", "c", "k2", "hit")], "run_id string, eval_id string, cache_key string, cache_status string")
    assert sorted(r.eval_id for r in constraints.judge_mismatches(judged, lookups, frame([("k1",)], "cache_key string")).collect()) == ["b", "c", "d"]
    assigned = frame([("x", 0, 0), ("x", 1, 1), ("y", 5, 0), ("z", 0, 0), ("z", 0, 0)], "clustering_run_id string, cluster_number int, document_index long")
    runs = frame([("x", 2, 2), ("y", 2, 2), ("z", 1, 2)], "clustering_run_id string, cluster_count int, trace_count long")
    assert sorted(r.clustering_run_id for r in constraints.assignment_faults(assigned, runs).collect()) == ["y", "z"]
    labels = frame([("x", 0, None, None, 0, 1), ("x", 0, "A", "a", 1, 2), ("x", 0, "A", "a", 2, 3), ("x", 1, None, None, 0, 5), ("x", 1, "B", None, 1, 6)], "clustering_run_id string, cluster_number int, label string, label_key string, version long, updated_at int")
    assert sorted((r.cluster_number, r.version) for r in constraints.label_updates(labels).collect()) == [(0, 2), (1, 1)]
