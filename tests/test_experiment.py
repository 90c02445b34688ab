"""From trace files to a verdict over a catalog, through the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from assayer import cli
from assayer.functions.json_text import quote
from assayer.operators.judging import response
from assayer.operators.scoring import ScorerError
from assayer.plans import config, constraints, export, slicing
from assayer.plans.experiment import Experiment, OperationalError, check_coverage, load_detail, load_report
from assayer.plans.store import Catalog, StoreError
from assayer.sources import fixtures
from assayer.sources.http_provider import HttpProvider, ProviderError, base_url, metadata_of

TOPICS = {"refund": "refund the invoice amount paid twice", "password": "reset my login password account", "shipping": "where is the parcel shipping delivery"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    lines = [json.dumps({"trace_id": f"{t}-{i}", "timestamp": f"2026-01-0{i + 1}T00:00:00Z", "task_type": "support", "prompt": f"{text} number{i} {text}", "response": f"answer {t} {i}"}) for t, text in TOPICS.items() for i in range(4)]
    (root / "traces.jsonl").write_text("\n".join([*lines, "{bad"]), "utf-8")
    return root


def run(spark, root, *args):
    return cli.main(["--store", f"file://{root}/store", *args], spark)


@pytest.fixture(scope="module")
def built(spark, store):
    """The store with traces, slices and a sealed dataset of six cases, two for each mode."""
    assert run(spark, store, "ingest", str(store / "traces.jsonl")) == 0
    catalog = Catalog(spark, f"file://{store}/store")
    clusters = slicing.cluster_traces(catalog, "topics", 3, restarts=20)
    members = catalog.read("cluster_assignments").collect()
    by = {n: {m.trace_id.split("-")[0] for m in members if m.cluster_number == n} for n in range(3)}
    assert by == {0: {"password"}, 1: {"refund"}, 2: {"shipping"}}
    catalog.rename_slice(clusters, 1, " Refunds ")
    overrides = spark.createDataFrame([], fixtures.OVERRIDES)
    first = slicing.build_from_slices(catalog, clusters, "probe", "1", 6, overrides)
    picked = sorted(r.source_trace_id for r in catalog.read("cases").filter(F.col("dataset_id") == first).collect())
    listed = [{"source_trace_id": t, "mode": "rubric", "rubric": ["clear", "kind"], "priority": "critical"} for t in picked if t.startswith("password")]
    listed += [{"source_trace_id": t, "mode": "deterministic", "scorers": [{"name": "contains", "config": {"substring": "answer"}}, {"name": "regex", "config": {"pattern": r"\d"}}]} for t in picked if t.startswith("shipping")]
    (store / "cases.json").write_text(json.dumps({"schema_version": 1, "cases": listed}))
    assert run(spark, store, "dataset", "build", "core", "1", "--run", clusters, "--size", "6", "--cases", str(store / "cases.json")) == 0
    return catalog, clusters, picked


def files(store, catalog, candidate=lambda c: c.source_trace_id, gate="max_score_drop: 0.5\n  max_new_failures: 9"):
    dataset = catalog.find_dataset("core:1")
    cases = catalog.read("cases").filter(F.col("dataset_id") == dataset).collect()
    out = {"baseline": [], "candidate": [], "judge": []}
    for c in cases:
        good = c.reference_answer or "answer 1"
        out["baseline"].append({"eval_id": c.eval_id, "output": good})
        out["candidate"].append({"eval_id": c.eval_id, "output": candidate(c) or good})
        if c.evaluation_mode == "rubric":
            for role in ("baseline", "candidate"):
                passed = role == "baseline"
                out["judge"].append({"eval_id": c.eval_id, "role": role, "outputs": ["{", response([("clear", 1.0, True, "r"), ("kind", float(passed), passed, "r")], 0.9)]})
    for name, rows in out.items():
        (store / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (store / "e.yaml").write_text(f"schema_version: 1\nname: try\ndataset: core:1\nbaseline: {{provider: fixture, path: baseline.jsonl}}\ncandidate: {{provider: fixture, path: candidate.jsonl}}\njudge: {{provider: fixture, path: judge.jsonl, confidence_threshold: 0.7}}\ngate:\n  {gate}\n")
    return str(store / "e.yaml")


def test_pass_and_fail(spark, store, built, capsys):
    catalog, _, _ = built
    path = files(store, catalog, lambda c: None)
    assert run(spark, store, "experiment", "run", path, "--json") == 0
    report = json.loads(capsys.readouterr().out)
    assert report["verdict"] == "PASS" and report["schema_version"] == 2 and len(report["newly_failed"]) == 2
    path = files(store, catalog, lambda c: "other" if c.evaluation_mode == "reference" else None, "max_score_drop: 0.1\n  max_new_failures: 1\n  by_slice: {refunds: {max_new_failures: 1}}")
    assert run(spark, store, "experiment", "run", path) == 1
    assert "exceeds" in capsys.readouterr().out
    x = catalog.read("experiments").orderBy(F.desc("experiment_id")).collect()
    failed = [load_report(catalog, e.experiment_id) for e in x if load_report(catalog, e.experiment_id)["verdict"] == "FAIL"][0]
    assert [(v["scope"], v["metric"]) for v in failed["violations"]] == [("global", "score_drop"), ("global", "new_failures"), ("cluster-1", "score_drop"), ("cluster-1", "new_failures")]
    rows = load_detail(catalog, failed["experiment_id"]).collect()
    assert len(rows) == 6 and {r.slice_label for r in rows} == {"cluster-0", "Refunds", "cluster-2"}
    assert {tuple(r.candidate_review_reasons) for r in rows if r.evaluation_mode == "rubric"} == {("critical_failure",)}
    assert "FAIL" in export.report_text(failed)
    assert set(catalog.integrity().values()) == {0}
    target = store / "report.json"
    assert run(spark, store, "experiment", "export", failed["experiment_id"], str(target)) == 0
    first = target.read_text()
    assert run(spark, store, "experiment", "export", failed["experiment_id"], str(target)) == 2
    assert run(spark, store, "experiment", "export", failed["experiment_id"], str(target), "--overwrite") == 0 and target.read_text() == first
    assert run(spark, store, "experiment", "export", "none", str(store / "x")) == 2
    assert export.read_report(str(target))["experiment_id"] == failed["experiment_id"]
    for text, kind in (("{", "invalid"), ("[]", "invalid"), ('{"experiment_id":1,"comparison":[],"schema_version":3}', "unsupported_version"), (None, "unreadable")):
        (store / "bad.json").write_text(text) if text else (store / "bad.json").unlink()
        with pytest.raises(export.ReportError) as error:
            export.read_report(str(store / "bad.json"))
        assert error.value.kind == kind
    assert export.pretty({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}' and "shown" in export.pretty({1, 2})


def test_judgments_are_cached(spark, store, built):
    catalog, _, _ = built
    attempt = lambda: load_report(catalog, Experiment(catalog, config.load_config(files(store, catalog, lambda c: "answer 1 again" if c.evaluation_mode == "rubric" else None))).run())
    first, second = attempt(), attempt()
    assert sum(r["cache_misses"] for r in second["judge"]) == 0 and sum(r["cache_hits"] for r in second["judge"]) == 4
    assert sum(r["cache_misses"] for r in first["judge"]) >= 2
    same = lambda r: [{k: v for k, v in c.items()} for c in r["comparison"]]
    assert same(first) == same(second)
    attempts = catalog.read("judge_attempts").filter(F.col("experiment_id") == first["experiment_id"]).collect()
    assert {a.error_code for a in attempts} == {"malformed", None}


class Model(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        assert body["stream"] is False and body["options"].get("seed", 42) == 42
        if body["model"] == "broken":
            answer = {"response": 1, "done": True}
        elif body.get("format") == "json":
            text = "{" if "Answer again" not in body["prompt"] else response([("clear", 1.0, True, "r"), ("kind", 0.0, False, "r")], 0.5)
            answer = {"response": text, "done": True}
        else:
            answer = {"response": "answer 1", "done": True, "eval_count": 3, "context": [1]}
        if body["model"] in ("says", "absent"):
            answer = {"error": "out of memory" if body["model"] == "says" else "no such model"}
        raw = json.dumps(answer).encode()
        self.send_response(404 if body["model"] == "absent" else 200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_model_behind_http(spark, store, built, service):
    catalog, _, _ = built
    text = "schema_version: 1\nname: live\ndataset: core:1\nbaseline: {{provider: ollama, model: m, base_url: '{0}'}}\ncandidate: {{provider: ollama, model: {1}, base_url: '{0}'}}\njudge: {{provider: ollama, model: j, base_url: '{0}'}}\ngate: {{max_score_drop: 0}}\n"
    (store / "live.yaml").write_text(text.format(service, "m"))
    report = load_report(catalog, Experiment(catalog, config.load_config(str(store / "live.yaml"))).run())
    assert report["verdict"] == "PASS" and {r["needs_review"] for r in report["judge"]} == {2}
    assert report["providers"]["baseline"]["settings"]["model"] == "m"
    latencies = catalog.read("case_results").filter(F.col("experiment_id") == report["experiment_id"])
    from assayer.plans.reports import latency

    assert latency(latencies).head().available
    kept = catalog.read("outputs").filter(F.col("experiment_id") == report["experiment_id"]).collect()
    assert {r.metadata for r in kept} == {'{"done": true, "eval_count": 3}'}
    assert load_detail(catalog, report["experiment_id"]).count() == 6
    with pytest.raises(constraints.ConstraintError, match="stored twice"):
        stored = catalog.read("case_results").filter(F.col("experiment_id") == report["experiment_id"])
        check_coverage(catalog.read("cases").filter(F.col("dataset_id") == catalog.find_dataset("core:1")), stored.unionByName(stored.limit(1)), catalog.read("case_comparisons").filter(F.col("experiment_id") == report["experiment_id"]))
    with pytest.raises(constraints.ConstraintError, match="cover"):
        check_coverage(catalog.read("cases").filter(F.col("dataset_id") == catalog.find_dataset("core:1")), stored.filter("role = 'baseline'"), catalog.read("case_comparisons"))
    (store / "live.yaml").write_text(text.format(service, "broken"))
    with pytest.raises(OperationalError, match="finished response"):
        Experiment(catalog, config.load_config(str(store / "live.yaml"))).run()


def test_metadata_of_a_response(service):
    assert metadata_of({"response": "x", "done": True, "model": "m", "eval_duration": 0, "context": [1], "created_at": None}) == {"done": True, "model": "m", "eval_duration": 0}
    for wrong in ({"model": 1}, {"eval_count": True}, {"load_duration": -1}, {"total_duration": 1.5}):
        with pytest.raises(ValueError, match="must be"):
            metadata_of(wrong)
    with pytest.raises(ProviderError, match="response: e: out of memory"):
        HttpProvider(service, "says").generate("e", "p")
    with pytest.raises(ProviderError, match="status: e: 404 no such model"):
        HttpProvider(service, "absent").generate("e", "p")
    assert HttpProvider(service, "m", seed=None).generate("e", "p")[0] == "answer 1"


def test_addresses():
    assert base_url(" HTTP://Host.Example:80/ ") == "http://host.example:80"
    for bad in ("ftp://a", "http://", "http://u:p@a", "http://a/b", "http://a?x=1"):
        with pytest.raises(ValueError):
            base_url(bad)
    with pytest.raises(ProviderError, match="transport"):
        HttpProvider("http://127.0.0.1:9", "m", timeout=2).generate("e", "p")


def test_preflight_writes_nothing(spark, store, built):
    catalog, _, _ = built
    before = catalog.read("experiments").count()
    path = files(store, catalog, lambda c: None)
    (store / "candidate.jsonl").write_text((store / "candidate.jsonl").read_text().split("\n", 1)[1])
    assert run(spark, store, "experiment", "run", path) == 2
    path = files(store, catalog, lambda c: None, "by_slice: {nowhere: {}}")
    assert run(spark, store, "experiment", "run", path) == 2
    assert catalog.read("experiments").count() == before


def test_a_failure_leaves_a_trail(spark, store, built, monkeypatch):
    catalog, _, _ = built
    attempt = Experiment(catalog, config.load_config(files(store, catalog, lambda c: None)))
    real = attempt._role
    monkeypatch.setattr(attempt, "_role", lambda role, run: real(role, run) if role == "baseline" else 1 / 0)
    with pytest.raises(OperationalError) as error:
        attempt.run()
    assert error.value.stage == "candidate"
    report = load_report(catalog, attempt.id)
    assert (report["status"], report["verdict"], report["failure_stage"]) == ("failed", None, "candidate")
    events = catalog.read("run_events").filter(F.col("experiment_id") == attempt.id)
    status = {r.status for r in constraints.current_status(events, "run_id").collect()}
    assert status == {"completed", "failed"}


def test_sealed_datasets_and_labels(spark, store, built):
    catalog, clusters, picked = built
    dataset = catalog.find_dataset("core:1")
    with pytest.raises(StoreError, match="sealed"):
        catalog.add_cases(dataset, catalog.read("cases").limit(0))
    with pytest.raises(StoreError, match="exists"):
        catalog.create_dataset("core", "1")
    with pytest.raises(StoreError, match="labeled"):
        catalog.rename_slice(clusters, 0, "REFUNDS")
    catalog.rename_slice(clusters, 1, "Refunds")
    assert [(r.cluster_number, r.label, r.trace_count) for r in catalog.slices(clusters).collect()] == [(0, None, 4), (1, "Refunds", 4), (2, None, 4)]
    assert catalog.read("cluster_labels").count() == 4
    names = {r.name: r.case_count for r in catalog.datasets().collect()}
    assert names["core"] == 6
    again = slicing.build_from_slices(catalog, clusters, "core", "2", 6, spark.createDataFrame([], fixtures.OVERRIDES))
    assert sorted(r.source_trace_id for r in catalog.read("cases").filter(F.col("dataset_id") == again).collect()) != []
    assert slicing.changed_sources(catalog, clusters).count() == 0


def test_manual_datasets(spark, store, built, capsys):
    assert run(spark, store, "dataset", "create", "manual", "1") == 0
    assert run(spark, store, "dataset", "add-trace", "manual:1", "refund-0") == 0
    assert run(spark, store, "dataset", "add-trace", "manual:1", "refund-0") == 1
    assert run(spark, store, "dataset", "add-trace", "manual:1", "refund-1", "--mode", "deterministic", "--scorers", '[{"name":"json_validity","config":{}}]') == 0
    assert run(spark, store, "dataset", "add-trace", "manual:1", "refund-2", "--mode", "deterministic", "--scorers", '[{"name":"nope"}]') == 2
    capsys.readouterr()
    assert run(spark, store, "dataset", "show", "manual:1") == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert [x["record_type"] for x in lines] == ["dataset", "case", "case"] and "reference_answer" not in [c for c in lines if c.get("evaluation_mode") == "deterministic"][0]
    assert run(spark, store, "dataset", "export", "manual:1", str(store / "d.jsonl")) == 0
    assert run(spark, store, "dataset", "export", "manual:1", str(store / "d.jsonl")) == 1
    assert run(spark, store, "traces", "list", "--limit", "2") == 0
    assert run(spark, store, "version") == 0


@pytest.mark.parametrize(
    ("text", "match"),
    [("schema_version: 1\nschema_version: 1\n", "repeated"), ("schema_version: 2\nname: a\ndataset: b:1\nbaseline: {provider: x}\ncandidate: {provider: x}\n", "schema_version"), ("a: 1\n", "must be given"), ("schema_version: 1\nname: a\ndataset: b:1\nbaseline: {provider: fixture}\ncandidate: {provider: x}\n", "path"), ("schema_version: 1\nname: a\ndataset: b:1\nbaseline: {provider: x}\ncandidate: {provider: x}\ngate: {max_score_drop: .nan}\n", "number")],
)
def test_faulty_configurations(tmp_path, text, match):
    (tmp_path / "c.yaml").write_text(text)
    with pytest.raises(config.ConfigError, match=match):
        config.load_config(str(tmp_path / "c.yaml"))


def test_configuration_hash_leaves_names_out(tmp_path):
    text = "schema_version: 1\nname: {}\ndataset: b:1\nbaseline: {{provider: fixture, path: {}}}\ncandidate: {{provider: fixture, path: c}}\ngate: {{max_score_drop: {}}}\n"
    made = []
    for values in (("a", "x", 0), ("b", "y", 0), ("a", "x", 0.5)):
        (tmp_path / "c.yaml").write_text(text.format(*values))
        made.append(config.configuration_hash(config.load_config(str(tmp_path / "c.yaml")), {}, {}))
    assert made[0] == made[1] != made[2]


def test_constraints(spark):
    rows = spark.createDataFrame([("deterministic", ["s"], None, None, None), ("deterministic", None, None, None, None), ("reference", None, None, "a", "a"), ("reference", None, None, " ", None), ("rubric", None, ["r"], None, None), ("rubric", None, ["r"], "a", None), ("other", None, None, None, None)], "evaluation_mode string, scorers array<string>, rubric array<string>, reference_answer string, source_response string")
    assert [r[0] for r in rows.select(constraints.case_shape()).collect()] == [True, False, True, False, True, False, False]
    with pytest.raises(constraints.ConstraintError):
        constraints.check(rows, constraints.case_shape(), "shape")
    states = spark.createDataFrame([("running", None, None, None, None), ("completed", 1, "PASS", None, None), ("completed", 1, None, None, None), ("failed", 1, None, "s", "m"), ("failed", 1, "PASS", "s", "m")], "status string, completed_at int, verdict string, failure_stage string, failure_message string")
    assert [r[0] for r in states.select(constraints.experiment_state()).collect()] == [True, True, False, True, False]
    runs = spark.createDataFrame([("pending", None, None, None), ("skipped", None, 1, None), ("completed", None, 1, None), ("failed", 1, 1, "m")], "status string, started_at int, completed_at int, failure_message string")
    assert [r[0] for r in runs.select(constraints.run_state()).collect()] == [True, True, False, True]
    parent = spark.createDataFrame([(1,)], "k int")
    assert constraints.orphans(spark.createDataFrame([(1,), (2,), (None,)], "k int"), parent, "k").count() == 1
    held = spark.createDataFrame([("e", None), ("f", "x")], "eval_id string, label string")
    assert constraints.changed_provenance(held, held.limit(1), "eval_id", ["label"]).count() == 1


def test_an_experiment_takes_few_jobs(spark, store, built):
    """Steps are made once and read by all that need them: the time of small jobs is most of an experiment's."""
    catalog, context = built[0], spark.sparkContext
    made = config.load_config(files(store, catalog))
    context.setJobGroup("few-jobs", "")
    try:
        name = Experiment(catalog, made).run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert load_report(catalog, name)["status"] == "completed"
    assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) < 190  # 153; 220 when steps were made anew for each table


def test_scorers_are_checked_where_they_lie(spark, tmp_path):
    """A scorer that can't run ends the preflight, without a list of all scorers at the driver."""
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    dataset = catalog.create_dataset("scorers", "1")
    rows = [(f"e{i}", dataset, f"t{i}", "deterministic", [("regex", '{"pattern":"("}' if i == 3 else '{"pattern":"a"}')]) for i in range(6)]
    catalog.add_cases(dataset, spark.createDataFrame(rows, "eval_id string, dataset_id string, source_trace_id string, evaluation_mode string, scorers array<struct<name:string,config:string>>"))
    for role in ("baseline", "candidate"):
        (tmp_path / f"{role}.jsonl").write_text("\n".join(json.dumps({"eval_id": r[0], "output": "a"}) for r in rows))
    (tmp_path / "e.yaml").write_text("schema_version: 1\nname: try\ndataset: scorers:1\nbaseline: {provider: fixture, path: baseline.jsonl}\ncandidate: {provider: fixture, path: candidate.jsonl}\ngate: {max_score_drop: 0.5, max_new_failures: 9}\n")
    with pytest.raises(ScorerError, match="regex"):
        Experiment(catalog, config.load_config(str(tmp_path / "e.yaml"))).run()
    assert catalog.read("experiments").isEmpty()


def test_quoted_texts_stay_in_the_jvm(spark, capsys):
    texts = [*map(chr, range(160)), "".join(map(chr, range(40))), 'a"b\\c\n\\n', "\\u000b\x0b", "é\u2028𝒳", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quote(F.col("t")).alias("q"))
    assert all(r.q == (None if r.t is None else json.dumps(r.t, ensure_ascii=False)) for r in rows.collect())
    rows.explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")
