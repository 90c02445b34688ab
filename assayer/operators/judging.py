"""Rubric judging: strict validation of responses, retries, review state and the result cache."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ids import sha256
from assayer.functions.json_text import canonical_dumps, strict_loads
from assayer.functions.text import nonblank

#: A reported overall score may differ so much from the mean of the criteria.
TOLERANCE = 1e-6
MAX_ATTEMPTS = 2
CACHE_TAG = "assayer.judge-cache.v1\0"


class JudgeError(ValueError):
    """A response that doesn't hold; code says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _share(value: Any, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= 1:
        raise JudgeError("schema_validation", f"{where} must be a number from 0 to 1")
    return float(value)


def _fields(value: Any, names: set[str], where: str) -> dict[str, Any]:
    if not isinstance(value, dict) or set(value) != names:
        raise JudgeError("schema_validation", f"{where} must have exactly {', '.join(sorted(names))}")
    return value


def parse_response(raw: str, rubric: list[str]) -> dict[str, Any]:
    """The checked response, its criteria in the rubric's order, or JudgeError."""
    try:
        value = strict_loads(raw, unique_keys=True)
    except (ValueError, RecursionError) as error:
        raise JudgeError("invalid_json", str(error)) from error
    if not isinstance(value, dict):
        raise JudgeError("root_type", "the response must be an object")
    _fields(value, {"schema_version", "criteria", "overall_score", "overall_passed", "confidence"}, "response")
    if type(value["schema_version"]) is not int or value["schema_version"] != 1:
        raise JudgeError("schema_validation", "schema_version must be 1")
    if not isinstance(value["criteria"], list) or not value["criteria"]:
        raise JudgeError("schema_validation", "criteria must be a list that isn't empty")
    overall, confidence = _share(value["overall_score"], "overall_score"), _share(value["confidence"], "confidence")
    if not isinstance(value["overall_passed"], bool):
        raise JudgeError("schema_validation", "overall_passed must be true or false")
    criteria: list[dict[str, Any]] = []
    for c in value["criteria"]:
        _fields(c, {"criterion", "score", "passed", "reason"}, "criterion")
        if not isinstance(c["criterion"], str) or not isinstance(c["passed"], bool) or not isinstance(c["reason"], str) or not c["reason"].strip():
            raise JudgeError("schema_validation", "a criterion needs its text, a verdict and a reason")
        criteria.append({"criterion": c["criterion"], "score": _share(c["score"], "score"), "passed": c["passed"], "reason": c["reason"].strip()})
    names = [c["criterion"] for c in criteria]
    faults = [("missing", sorted(set(rubric) - set(names))), ("unknown", sorted(set(names) - set(rubric))), ("duplicate", sorted({n for n in names if names.count(n) > 1}))]
    if any(found for _, found in faults):
        raise JudgeError("criterion_coverage", "; ".join(f"{what}: {', '.join(map(repr, found))}" for what, found in faults if found))
    held = {c["criterion"]: c for c in criteria}
    ordered = [held[r] for r in rubric]
    mean = sum(c["score"] for c in ordered) / len(ordered)
    if abs(overall - mean) > TOLERANCE:
        raise JudgeError("overall_score_mismatch", f"overall_score {overall} isn't the mean {mean}")
    if value["overall_passed"] is not all(c["passed"] for c in ordered):
        raise JudgeError("overall_pass_mismatch", "overall_passed isn't the criteria's")
    return {"criteria": ordered, "score": mean, "overall_score": overall, "passed": value["overall_passed"], "confidence": confidence}


_CRITERION = T.StructType([T.StructField("criterion", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()), T.StructField("reason", T.StringType())])
_JUDGED = T.StructType(
    [
        T.StructField("attempts", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("code", "error")],
        *[T.StructField(c, T.DoubleType()) for c in ("score", "overall_score")],
        T.StructField("passed", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("criteria", T.ArrayType(_CRITERION)),
    ]
)


@F.pandas_udf(_JUDGED)
def judge_outputs(outputs: pd.Series, rubrics: pd.Series) -> pd.DataFrame:
    """The first response that holds among the first two; else the last error. Only malformed output is tried again."""
    rows = []
    for listed, rubric in zip(outputs, rubrics, strict=True):
        row: tuple = (0, "no_output", None, None, None, None, None, None)
        if listed is not None and rubric is not None:
            for i, raw in enumerate(list(listed)[:MAX_ATTEMPTS]):
                try:
                    r = parse_response(raw, list(rubric))
                except JudgeError as error:
                    row = (i + 1, error.code, str(error), None, None, None, None, None)
                else:
                    row = (i + 1, None, None, r["score"], r["overall_score"], r["passed"], r["confidence"], r["criteria"])
                    break
        rows.append(row)
    return pd.DataFrame(rows, columns=["attempts", "code", "error", "score", "overall_score", "passed", "confidence", "criteria"])


def judge_cases(cases: DataFrame, responses: DataFrame, threshold: float) -> DataFrame:
    """Judged rubric cases with their review state.

    cases: eval_id, evaluation_mode, priority, rubric. responses: role, eval_id, outputs (1 or 2).
    The score kept is the mean of the criteria; the reported one stays beside it. code is null
    where a response holds.
    """
    rows = responses.join(cases.filter(F.col("evaluation_mode") == "rubric").select("eval_id", "evaluation_mode", "priority", "rubric"), "eval_id")
    return judged(rows, threshold).select("role", "eval_id", "evaluation_mode", "priority", *_JUDGED.names, "below_threshold", "review_reasons", "review_status")


def judged(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (outputs, rubric, priority and others) with the judgment of each and its review state."""
    return with_review(rows.withColumn("j", judge_outputs(F.col("outputs"), F.col("rubric"))).select(*rows.columns, "j.*"), threshold)


def review_reasons(confidence: Column, passed: Column, priority: Column, threshold: float) -> Column:
    low = F.when(confidence < threshold, F.lit("low_confidence"))
    critical = F.when((priority == "critical") & ~passed, F.lit("critical_failure"))
    return F.array_compact(F.array(low, critical))


def with_review(judged: DataFrame, threshold: float) -> DataFrame:
    """judged (confidence, passed, priority) with below_threshold, review_reasons and review_status."""
    reasons = review_reasons(F.col("confidence"), F.col("passed"), F.col("priority"), threshold)
    out = judged.withColumn("below_threshold", F.col("confidence") < threshold).withColumn("review_reasons", reasons)
    return out.withColumn("review_status", F.when(F.size("review_reasons") > 0, "needs_review").otherwise("not_required"))


def cache_key(identity: Column) -> Column:
    """The key of a canonical identity: what makes two judgments the same. Limits of time and confidence aren't part of it."""
    return sha256(F.concat(F.lit(CACHE_TAG), identity))


def cache_identity(case: dict[str, Any], output: str, prompts: dict[str, str], provider: dict[str, Any]) -> str:
    """The canonical identity of one judgment."""
    return canonical_dumps(
        {
            "key_version": 1,
            "judge_input": {k: case.get(k) for k in ("context", "criteria", "input", "priority")} | {"output": output},
            "prompt": prompts,
            "provider": provider,
            "request_contract": {"version": 1, "response_format": "json"},
            "validation_contract": {"version": 1, "response_schema_version": 1, "max_malformed_retries": MAX_ATTEMPTS - 1, "overall_score_abs_tolerance": TOLERANCE},
        }
    )


def look_up(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (with cache_key) with raw_response and cache_status: hit or miss, recorded before any call."""
    held = cache.select("cache_key", "raw_response")
    return wanted.join(held, "cache_key", "left").withColumn("cache_status", F.when(F.col("raw_response").isNotNull(), "hit").otherwise("miss"))


def cache_faults(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(cache_key, fault) of hits that aren't what was asked: wanted and cache have cache_key and identity_json.

    A key must be the hash of its identity, the identity must be the one asked for, in canonical form,
    and an answer must be there.
    """
    from assayer.functions.json_text import canonical_json

    asked = wanted.select("cache_key", F.col("identity_json").alias("asked")).distinct()
    held = cache.select("cache_key", "identity_json", "raw_response").join(asked, "cache_key")
    fault = (
        F.when(F.col("raw_response").isNull(), "no answer")
        .when(F.col("identity_json").isNull() | ~canonical_json("identity_json").eqNullSafe(F.col("identity_json")), "identity isn't canonical")
        .when(F.col("identity_json") != F.col("asked"), "another identity")
        .when(cache_key(F.col("identity_json")) != F.col("cache_key"), "key isn't the identity's hash")
    )
    return held.withColumn("fault", fault).filter("fault is not null").select("cache_key", "fault")


def new_entries(made: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries to append: the first writer of a key wins, in the cache and among made (by written_at, then raw_response)."""
    columns = [c for c in made.columns if c != "cache_key"]
    first = made.groupBy("cache_key").agg(F.min_by(F.struct(*columns), F.struct("written_at", "raw_response")).alias("e"))
    return first.select("cache_key", "e.*").join(cache.select("cache_key"), "cache_key", "left_anti")


def request_prompt(template: str, task: Column, output: Column, criteria: Column, context: Column) -> Column:
    """The judge's prompt: the template and a canonical JSON object of what is judged."""
    from assayer.functions.json_text import fixed_object, quote

    listed = F.concat(F.lit("["), F.array_join(F.transform(criteria, quote_simple), ","), F.lit("]"))
    body = fixed_object(context=F.coalesce(context, F.lit("{}")), criteria=listed, input=quote(task), output=quote(output))
    return F.concat(F.lit(template.rstrip() + "\n\n"), body)


def quote_simple(col: Column) -> Column:
    """A JSON string of a text, in the JVM."""
    whole = F.to_json(F.array(col))  # escapes control characters
    return F.when(col.rlike(r"[\x00-\x1F]"), F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise(F.concat(F.lit('"'), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def rubric_faults(cases: DataFrame) -> DataFrame:
    """Rubric cases whose criteria are blank or repeat after stripping."""
    from assayer.functions.text import strip

    kept = F.transform("rubric", strip)
    bad = F.exists("rubric", lambda c: ~nonblank(c)) | (F.size(F.array_distinct(kept)) < F.size("rubric")) | (F.size("rubric") == 0)
    return cases.filter((F.col("evaluation_mode") == "rubric") & bad)


def counters(judged: DataFrame) -> DataFrame:
    """By role: low confidence, needs review, cache hits and misses."""
    status = F.col("cache_status") if "cache_status" in judged.columns else F.lit(None)
    return judged.groupBy("role").agg(
        F.count_if("below_threshold").alias("low_confidence"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        F.count_if(status == "hit").alias("cache_hits"),
        F.count_if(status == "miss").alias("cache_misses"),
    )


def response(criteria: list[tuple[str, float, bool, str]], confidence: float) -> str:
    """A response in the form that parse_response() takes, for fixtures."""
    listed = [{"criterion": c, "score": s, "passed": p, "reason": r} for c, s, p, r in criteria]
    return json.dumps({"schema_version": 1, "criteria": listed, "overall_score": sum(c["score"] for c in listed) / len(listed), "overall_passed": all(c["passed"] for c in listed), "confidence": confidence})
