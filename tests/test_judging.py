import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import judging
from assayer.operators.judging import JudgeError, parse_response, response

RUBRIC = ["clear", "kind"]


def good(**changes):
    value = json.loads(response([("kind", 0.0, False, " no "), ("clear", 1.0, True, "yes")], 0.8))
    return json.dumps(value | changes)


def test_order_and_mean():
    got = parse_response(good(overall_score=0.5000005), RUBRIC)
    assert [c["criterion"] for c in got["criteria"]] == RUBRIC and got["criteria"][1]["reason"] == "no"
    assert (got["score"], got["overall_score"], got["passed"]) == (0.5, 0.5000005, False)


def criteria(**changes):
    return [{"criterion": "clear", "score": 1, "passed": True, "reason": "y"} | changes, {"criterion": "kind", "score": 0, "passed": False, "reason": "n"}]


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ("{", "invalid_json"), ("```json\n{}\n```", "invalid_json"), ('{"a":1,"a":2}', "invalid_json"), (good().replace("0.8", "1e999"), "invalid_json"), ("[]", "root_type"),
        (good(confidence=1.1), "schema_validation"), (good(confidence=-0.1), "schema_validation"), (good(confidence=True), "schema_validation"), (good(schema_version=True), "schema_validation"), (good(schema_version=1.0), "schema_validation"),
        (good(extra=1), "schema_validation"), (good(criteria=[]), "schema_validation"), (good(criteria=criteria(score="0.25")), "schema_validation"), (good(criteria=criteria(reason=" ")), "schema_validation"), (good(criteria=criteria(passed=1)), "schema_validation"),
        (good(criteria=criteria()[:1]), "criterion_coverage"), (good(criteria=criteria(criterion="clear ")), "criterion_coverage"), (good(criteria=criteria() + criteria()[:1]), "criterion_coverage"),
        (good(overall_score=0.500002), "overall_score_mismatch"), (good(overall_passed=True), "overall_pass_mismatch"),
    ],
)
def test_codes(raw, code):
    with pytest.raises(JudgeError) as error:
        parse_response(raw, RUBRIC)
    assert error.value.code == code


def test_retries_and_review(spark):
    sure, unsure = response([("clear", 1.0, True, "r"), ("kind", 1.0, True, "r")], 0.9), response([("clear", 0.0, False, "r"), ("kind", 1.0, True, "r")], 0.4)
    cases = spark.createDataFrame([(n, "rubric", p, RUBRIC) for n, p in (("a", "high"), ("b", "critical"), ("c", "critical"), ("d", "high"))], "eval_id string, evaluation_mode string, priority string, rubric array<string>")
    rows = spark.createDataFrame([("baseline", "a", ["{", sure]), ("baseline", "b", [unsure]), ("baseline", "c", [sure, "{"]), ("baseline", "d", ["{", "[]"])], "role string, eval_id string, outputs array<string>")
    got = {r.eval_id: r for r in judging.judge_cases(cases, rows, 0.7).collect()}
    assert (got["a"].attempts, got["a"].score, got["a"].review_status) == (2, 1.0, "not_required")
    assert (got["b"].score, got["b"].review_reasons, got["b"].review_status) == (0.5, ["low_confidence", "critical_failure"], "needs_review")
    assert (got["c"].attempts, got["c"].review_reasons) == (1, [])
    assert (got["d"].attempts, got["d"].code, got["d"].score) == (2, "root_type", None)
    assert judging.counters(judging.judge_cases(cases, rows, 0.7)).head().needs_review == 1


@pytest.mark.parametrize(("priority", "confidence", "passed", "reasons"), [("high", 0.70, False, []), ("high", 0.69, False, ["low_confidence"]), ("critical", 0.90, False, ["critical_failure"]), ("critical", 0.40, False, ["low_confidence", "critical_failure"]), ("critical", 0.90, True, [])])
def test_review_states(spark, priority, confidence, passed, reasons):
    row = spark.createDataFrame([(priority, confidence, passed)], "priority string, confidence double, passed boolean")
    assert judging.with_review(row, 0.7).head().review_reasons == reasons


def test_cache(spark):
    identity = judging.cache_identity({"context": {}, "criteria": RUBRIC, "input": "i", "priority": "high"}, "o", {"version": "1"}, {"model": "m"})
    assert identity != judging.cache_identity({"context": {}, "criteria": RUBRIC, "input": "i", "priority": "high"}, "p", {"version": "1"}, {"model": "m"})
    keys = spark.createDataFrame([(identity,), ("other",)], "i string").select(judging.cache_key(F.col("i")).alias("cache_key"))
    cache = keys.limit(1).withColumn("raw_response", F.lit("held"))
    assert sorted(r.cache_status for r in judging.look_up(keys, cache).collect()) == ["hit", "miss"]
    made = keys.crossJoin(spark.createDataFrame([("second", 2), ("first", 1)], "raw_response string, written_at int"))
    fresh = judging.new_entries(made, cache).collect()
    assert [(r.raw_response, r.written_at) for r in fresh] == [("first", 1)]
    text = judging.request_prompt("Judge.", F.lit('in"'), F.lit("out"), F.array(F.lit("a"), F.lit('b"')), F.lit("{}"))
    assert json.loads(spark.range(1).select(text).head()[0].split("\n\n")[1]) == {"context": {}, "criteria": ["a", 'b"'], "input": 'in"', "output": "out"}


def test_criteria_with_control_characters_are_json(spark):
    import json

    texts = ["plain", 'a "b" \\ c', "line\nbreak\ttab", "\x01é/"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", judging.quote_simple(F.col("t")).alias("j")).collect()
    assert [json.loads(r.j) for r in rows] == [r.t for r in rows] == texts
