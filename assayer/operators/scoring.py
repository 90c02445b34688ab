"""Scorers of outputs, as column expressions where the rule is the same for all rows, and per case.

A scorer has a name and a JSON configuration; prepare() checks it before anything runs.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.json_text import strict_json, strict_loads
from assayer.functions.numbers import exact_mean
from assayer.functions.text import casefold, contains_folded

MODES = ("deterministic", "reference", "rubric")
#: Java and Python read these alike: no groups by name, no classes that Unicode widens.
PORTABLE = re.compile(r"(?:[A-Za-z0-9 _\-:;,.@#/<>=!%&'\"~^$*+?|()]|\[[A-Za-z0-9_.\- ]+\]|\\[.\-/()\[\]*+?|^$]|\{\d+(?:,\d*)?\})*")


class ScorerError(ValueError):
    """A scorer that can't run."""


@dataclass(frozen=True)
class Scorer:
    """A checked scorer. Unused settings are None."""

    name: str
    text: str | None = None
    case_sensitive: bool = True
    keys: tuple[str, ...] = ()

    def details(self) -> dict[str, Any]:
        names = {"exact_match": "expected", "contains": "substring", "regex": "pattern"}
        if self.name in names:
            return {names[self.name]: self.text, "case_sensitive": self.case_sensitive}
        return {"required_keys": list(self.keys)} if self.name == "required_keys" else {}


_SETTINGS = {
    "exact_match": ({"expected"}, {"case_sensitive"}),
    "contains": ({"substring"}, {"case_sensitive"}),
    "regex": ({"pattern"}, {"case_sensitive"}),
    "json_validity": (set(), set()),
    "required_keys": ({"keys"}, set()),
}


def prepare(name: str, config: dict[str, Any]) -> Scorer:
    """Checks a scorer's name and configuration, or raises ScorerError."""
    if name not in _SETTINGS:
        raise ScorerError(f"no scorer is named {name!r}")
    needed, allowed = _SETTINGS[name]
    if missing := needed - set(config):
        raise ScorerError(f"{name}: {', '.join(sorted(missing))} must be given")
    if extra := set(config) - needed - allowed:
        raise ScorerError(f"{name}: {', '.join(sorted(extra))} isn't known")
    sensitive = config.get("case_sensitive", True)
    if not isinstance(sensitive, bool):
        raise ScorerError(f"{name}: case_sensitive must be true or false")
    if name == "required_keys":
        keys = config["keys"]
        if not isinstance(keys, list) or not keys or not all(isinstance(k, str) and k.strip() for k in keys):
            raise ScorerError("required_keys: keys must be names that aren't blank")
        keys = [k.strip() for k in keys]
        if len(set(keys)) < len(keys):
            raise ScorerError("required_keys: keys must differ")
        return Scorer(name, keys=tuple(keys))
    if not needed:
        return Scorer(name)
    text = config[next(iter(needed))]
    if not isinstance(text, str):
        raise ScorerError(f"{name}: a text is needed")
    if name == "contains" and not text.strip():
        raise ScorerError("contains: substring must not be blank")
    if name == "regex":
        if not text:
            raise ScorerError("regex: pattern must not be empty")
        try:
            re.compile(text)
        except re.error as error:
            raise ScorerError(f"regex: {error}") from error
    return Scorer(name, text, sensitive)


def evaluate(scorer: Scorer, output: str) -> tuple[bool, dict[str, Any]]:
    """Whether one output passes, and details."""
    details = scorer.details()
    if scorer.name in ("exact_match", "contains"):
        a, b = (output, scorer.text) if scorer.case_sensitive else (output.casefold(), scorer.text.casefold())
        return (a == b if scorer.name == "exact_match" else b in a), details
    if scorer.name == "regex":
        return re.search(scorer.text, output, 0 if scorer.case_sensitive else re.IGNORECASE) is not None, details
    try:
        value = strict_loads(output)
    except (ValueError, RecursionError) as error:
        return False, details | {"error": str(error)}
    if scorer.name == "json_validity":
        return True, details
    if not isinstance(value, dict):
        return False, details | {"error": "not an object"}
    missing = [k for k in scorer.keys if k not in value]
    return not missing, details | {"missing_keys": missing}


# The same rule for every row, in the JVM where the rule allows it.


def exact_match(output: Column, expected: Column, case_sensitive: bool = True) -> Column:
    return output == expected if case_sensitive else casefold(output) == casefold(expected)


def contains(output: Column, substring: str, case_sensitive: bool = True) -> Column:
    return output.contains(substring) if case_sensitive else contains_folded(output, F.lit(substring))


def regex(output: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """rlike for patterns that Java and Python read alike, Python's re for others."""
    prepare("regex", {"pattern": pattern})
    if case_sensitive and PORTABLE.fullmatch(pattern) and "$" not in pattern and "(?" not in pattern:
        return output.rlike(pattern)
    compiled = re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)

    @F.pandas_udf(T.BooleanType())
    def search(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else compiled.search(x) is not None)

    return search(output)


def json_validity(output: Column) -> Column:
    return strict_json(output)["valid"]


def required_keys(output: Column, keys: list[str]) -> Column:
    keys = prepare("required_keys", {"keys": keys}).keys
    found = strict_json(output)
    return F.coalesce(found["is_object"] & (F.size(F.array_except(F.array(*map(F.lit, keys)), found["keys"])) == 0), F.lit(False))


_RESULT = T.StructType([T.StructField("scorer_index", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()), T.StructField("details", T.StringType())])
_RESULTS = T.ArrayType(_RESULT)


@F.pandas_udf(T.StringType())
def scorer_faults(scorers: pd.Series) -> pd.Series:
    """Of each case's scorers: why the first one that can't run can't."""

    def fault(listed: Any) -> str | None:
        try:
            for s in () if listed is None else listed:
                prepare(s["name"], json.loads(s["config"]))
        except (ValueError, RecursionError) as error:
            return str(error)
        return None

    return pd.Series([fault(listed) for listed in scorers], dtype=object)


@F.pandas_udf(_RESULTS)
def run_scorers(outputs: pd.Series, scorers: pd.Series) -> pd.Series:
    """Results of each case's own scorers (array of name and JSON configuration) on its output."""
    known: dict[tuple[str, str], Scorer] = {}

    def results(output: str | None, listed: Any) -> list[tuple] | None:
        if output is None or listed is None:
            return None
        out = []
        for i, s in enumerate(listed):
            key = (s["name"], s["config"])
            if key not in known:
                known[key] = prepare(key[0], json.loads(key[1]))
            passed, details = evaluate(known[key], output)
            out.append({"scorer_index": i, "name": key[0], "score": float(passed), "passed": passed, "details": json.dumps(details, ensure_ascii=False, sort_keys=True)})
        return out

    return pd.Series([results(o, s) for o, s in zip(outputs, scorers, strict=True)], dtype=object)


def score_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """(role, eval_id, evaluation_mode, output, score, passed, results) of deterministic and reference cases.

    cases: eval_id, evaluation_mode, reference_answer, scorers. outputs: role, eval_id, output. A
    reference case is one exact, case-sensitive match with its answer; that stays in the JVM. The
    score is the mean of the scorers' scores, passed when all passed.
    """
    rows = outputs.join(cases.filter(F.col("evaluation_mode") != "rubric").select("eval_id", "evaluation_mode", "reference_answer", "scorers"), "eval_id")
    reference = F.col("evaluation_mode") == "reference"
    same = F.col("output") == F.col("reference_answer")
    single = F.array(F.struct(F.lit(0).alias("scorer_index"), F.lit("exact_match").alias("name"), same.cast("double").alias("score"), same.alias("passed"), F.lit("{}").alias("details")))
    own = run_scorers(F.when(~reference, F.col("output")), F.col("scorers"))
    rows = rows.withColumn("results", F.when(reference, single).otherwise(own))
    passes = F.aggregate("results", F.lit(0), lambda n, r: n + r["passed"].cast("int"))
    return rows.select(
        "role", "eval_id", "evaluation_mode", "output",
        (passes / F.size("results")).alias("score"),
        F.forall("results", lambda r: r["passed"]).alias("passed"),
        "results",
    )


def case_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """Score and verdict of each case from one row for each scorer."""
    return results.groupBy(*keys).agg(exact_mean(F.col("score")).alias("score"), F.bool_and("passed").alias("passed"))
