"""Provider and judge fixtures, and case overrides: strict files checked against the expected cases."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions.json_text import strict_loads
from assayer.functions.shared import written
from assayer.operators.comparing import ROLES
from assayer.operators.judging import MAX_ATTEMPTS
from assayer.operators.scoring import prepare
from assayer.plans.constraints import CODES
from assayer.sources.traces import read_lines


class FixtureError(ValueError):
    """A fixture that doesn't fit."""


class Provider(Protocol):
    """Anything that turns a prompt into an output: the place for a remote model."""

    def generate(self, eval_id: str, prompt: str) -> str: ...


def _output_of(line: str) -> dict[str, Any]:
    value = _record(line, {"eval_id", "output"}, False)
    name, output = value["eval_id"], value["output"]
    if not isinstance(name, str) or not name.strip() or not isinstance(output, str):
        raise ValueError("both must be text, eval_id not blank")
    return {"eval_id": name, "output": output}


def _judgment_of(line: str) -> dict[str, Any]:
    value = _record(line, {"eval_id", "role", "outputs"}, True)
    listed = value["outputs"]
    if value["role"] not in ROLES or not isinstance(value["eval_id"], str) or not value["eval_id"].strip():
        raise ValueError("a role and an eval_id are needed")
    if not isinstance(listed, list) or not 1 <= len(listed) <= MAX_ATTEMPTS or not all(isinstance(x, str) for x in listed):
        raise ValueError("outputs must be one or two texts")
    return {"role": value["role"], "eval_id": value["eval_id"], "outputs": listed}


def _record(line: str, keys: set[str], unique: bool) -> dict[str, Any]:
    value = strict_loads(line, unique_keys=unique)
    if not isinstance(value, dict) or set(value) != keys:
        raise ValueError(f"exactly {', '.join(sorted(keys))} are needed")
    return value


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], dict[str, Any]], fields: str, keys: list[str]) -> DataFrame:
    """Rows of a fixture's lines, parsed on executors. The first line that doesn't parse, or repeats keys, is an error.

    Lines end as text files' do. The path is one that executors reach.
    """
    kinds = pa.schema([("error", pa.string()), *((f.name, pa.list_(pa.string()) if f.dataType.typeName() == "array" else pa.string()) for f in StructType.fromDDL(fields).fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for line in batch.column(1).to_pylist():
                try:
                    made.append({"error": None} | (parse(line) if line is not None else {}))  # null: not UTF-8
                except (ValueError, RecursionError) as error:
                    made.append({"error": str(error)})
            found = pa.Table.from_pylist(made, kinds).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["line", *kinds.names])

    lines = read_lines(spark, path).select(F.col("line").cast("long").alias("line"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("value"))
    rows = written(lines.mapInArrow(run, f"line long, error string, {fields}"), "fixture")
    blank, wrong = F.col("error").isNull() & F.col(keys[0]).isNull(), F.col("error").isNotNull()
    counted = rows.groupBy(wrong.alias("wrong"), blank.alias("blank"), *keys).agg(F.count("*").alias("n"), F.min("line").alias("first"), F.min_by(F.struct("line", "error"), "line").alias("f"))
    found = counted.agg(F.bool_or("blank").alias("blank"), F.min_by("f", F.when(F.col("wrong"), F.col("first"))).alias("f"), F.bool_or(~F.col("wrong") & ~F.col("blank") & (F.col("n") > 1)).alias("again")).head()
    if found["blank"]:
        raise FixtureError(f"{path}: not UTF-8")
    faulty, again = found["f"], None
    if found["again"]:
        first = rows.filter("error is null").groupBy(*keys).agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1")
        again = rows.join(first, keys).filter("line > first").agg(F.min_by(F.struct("line", *keys), "line").alias("r")).head()["r"]
    if again is not None and (faulty is None or again["line"] < faulty["line"]):
        raise FixtureError(f"{path}: line {again['line']}: {':'.join(again[k] for k in keys)} is repeated")
    if faulty is not None:
        raise FixtureError(f"{path}: line {faulty['line']}: {faulty['error']}")
    return rows


def read_outputs(spark: SparkSession, path: str, role: str) -> DataFrame:
    """(role, eval_id, output) of a provider fixture; an empty output is one too."""
    rows = _parsed(spark, path, _output_of, "eval_id string, output string", ["eval_id"])
    return rows.select(F.lit(role).alias("role"), "eval_id", "output")


def read_judge(spark: SparkSession, path: str) -> DataFrame:
    """(role, eval_id, outputs) of a judge fixture: one or two responses each; repeated keys are errors."""
    return _parsed(spark, path, _judgment_of, "role string, eval_id string, outputs array<string>", ["role", "eval_id"]).select("role", "eval_id", "outputs")


def coverage_faults(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, keys): expected keys that are missing, found ones that are unknown; both ways are anti joins."""
    sides = {"missing": (expected, found), "unknown": (found, expected)}
    missing, unknown = (a.join(b, keys, "left_anti").select(F.lit(kind).alias("kind"), *keys) for kind, (a, b) in sides.items())
    return missing.unionByName(unknown)


def check_coverage(expected: DataFrame, found: DataFrame, keys: list[str], what: str) -> None:
    """Every expected key is found and no other; else an error names the first few."""
    if rows := coverage_faults(expected, found, keys).orderBy("kind", *keys).limit(5).collect():
        raise FixtureError(f"{what}: " + ", ".join(f"{r[0]} " + ":".join(map(str, r[1:])) for r in rows))


def expected_judgments(cases: DataFrame) -> DataFrame:
    """(role, eval_id): each rubric case in both roles."""
    roles = F.explode(F.array(*map(F.lit, ROLES))).alias("role")
    return cases.filter("evaluation_mode = 'rubric'").select("eval_id", roles).select("role", "eval_id")


OVERRIDES = "source_trace_id string, mode string, rubric array<string>, scorers array<struct<name:string,config:string>>, priority string, review_status string"


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Case overrides by trace; without a file there are none."""
    if path is None:
        return spark.createDataFrame([], OVERRIDES)
    try:
        value = strict_loads(Path(path).read_text("utf-8-sig"), unique_keys=True)
    except ValueError as error:
        raise FixtureError(f"{path}: {error}") from error
    if not isinstance(value, dict) or set(value) != {"schema_version", "cases"} or value["schema_version"] != 1 or isinstance(value["schema_version"], bool):
        raise FixtureError(f"{path}: schema_version 1 and cases are needed")
    rows, seen = [], set()
    for i, case in enumerate(value["cases"]):
        where = f"{path}: case {i}"
        if not isinstance(case, dict) or (extra := set(case) - {"source_trace_id", "mode", "rubric", "scorers", "priority", "review_status"}):
            raise FixtureError(f"{where}: {', '.join(sorted(extra)) if isinstance(case, dict) else 'must be an object'} isn't known")
        name, mode = case.get("source_trace_id"), case.get("mode", "reference")
        rubric, scorers = case.get("rubric", []), case.get("scorers", [])
        if not isinstance(name, str) or not name.strip() or name in seen:
            raise FixtureError(f"{where}: source_trace_id must be text of its own")
        if mode not in CODES["evaluation_mode"] or case.get("priority", "medium") not in CODES["priority"]:
            raise FixtureError(f"{where}: mode or priority isn't known")
        if bool(rubric) != (mode == "rubric") or bool(scorers) != (mode == "deterministic"):
            raise FixtureError(f"{where}: {mode} cases need {'a rubric' if mode == 'rubric' else 'scorers' if mode == 'deterministic' else 'neither'}")
        kept = [r.strip() for r in rubric if isinstance(r, str) and r.strip()]
        if len(set(kept)) != len(rubric):
            raise FixtureError(f"{where}: criteria must be filled and differ")
        for s in scorers:
            prepare(s.get("name"), s.get("config", {}))
        seen.add(name)
        listed = [(s["name"], json.dumps(s.get("config", {}), sort_keys=True, ensure_ascii=False)) for s in scorers]
        rows.append((name, mode, kept or None, listed or None, case.get("priority"), case.get("review_status")))
    return spark.createDataFrame(rows, OVERRIDES)
