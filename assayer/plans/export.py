"""Deterministic exports: JSON Lines of datasets, JSON and text of reports; written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.json_text import canonical_dumps, canonical_json, strict_loads
from assayer.functions.shared import scratch, written
from assayer.plans.store import Catalog, StoreError


def write_text(path: str, text: str, overwrite: bool = False) -> None:
    """Writes a text to a file, whole or not at all."""

    def write(staged: str) -> None:
        with open(staged, "w", encoding="utf-8", newline="\n") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())

    _placed(path, write, overwrite)


def _placed(path: str, write: Callable[[str], None], overwrite: bool) -> None:
    """Writes beside the target and moves it into place; an existing file stays unless overwrite is asked."""
    target = Path(path)
    if target.exists() and not overwrite:
        raise StoreError(f"{path} exists")
    handle, staged = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    os.close(handle)
    try:
        write(staged)
        if overwrite:
            os.replace(staged, target)
        else:
            os.link(staged, target)  # fails where another writer was first
            os.unlink(staged)
    except BaseException:
        Path(staged).unlink(missing_ok=True)
        raise


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def _lines(catalog: Catalog, dataset: str) -> tuple[str, DataFrame]:
    """(the dataset's envelope, (line): its cases as canonical JSON by id, in ranges that executors make)."""
    head = catalog.read("datasets").filter(F.col("dataset_id") == dataset).head()
    if head is None:
        raise StoreError(f"{dataset} doesn't exist")
    cases = catalog.read("cases").filter(F.col("dataset_id") == dataset)
    filled = F.to_json(F.struct(F.lit("case").alias("record_type"), *cases.columns))  # nulls are left out
    ranged = cases.select("eval_id", canonical_json(filled).alias("value")).repartitionByRange("eval_id").sortWithinPartitions("eval_id")
    return canonical_dumps({"record_type": "dataset", **_plain(head)}), ranged.select("value")


def dataset_lines(catalog: Catalog, dataset: str) -> Iterator[str]:
    """The dataset's envelope, then its cases by id; the driver holds a range at a time."""
    head, rows = _lines(catalog, dataset)
    yield head
    for row in written(rows.withColumn("at", F.monotonically_increasing_id()), "dataset-lines").orderBy("at").toLocalIterator():
        yield row["value"]


def export_dataset(catalog: Catalog, dataset: str, path: str, overwrite: bool = False) -> None:
    """Writes the lines to a file: executors write ranges, whose bytes are joined in their order."""
    if Path(path).exists() and not overwrite:
        raise StoreError(f"{path} exists")
    head, rows = _lines(catalog, dataset)
    spark, folder = catalog.spark, scratch(catalog.spark, "dataset-lines")
    rows.write.option("lineSep", "\n").text(folder)
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in system.listStatus(home) if s.getPath().getName().startswith("part-"))

    def joined(staged: str) -> None:
        out = spark._jvm.java.io.FileOutputStream(staged)
        try:
            out.write(bytearray(head + "\n", "utf-8"))
            for name in parts:
                held = system.open(spark._jvm.org.apache.hadoop.fs.Path(home, name))
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                finally:
                    held.close()
            out.getFD().sync()
        finally:
            out.close()

    _placed(path, joined, overwrite)
    system.delete(home, True)


def export_report(report: dict[str, Any], path: str, overwrite: bool = False) -> None:
    write_text(path, canonical_dumps(_plain(report)) + "\n", overwrite)


class ReportError(ValueError):
    """A report that can't be shown; kind is unreadable, invalid or unsupported_version."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def read_report(path: str | None = None, variable: str = "ASSAYER_REPORT", default: str = "report.json") -> dict[str, Any]:
    """An exported report: from path, else the environment's, else the default place."""
    file = path or os.environ.get(variable) or default
    try:
        text = Path(file).read_text("utf-8")
    except (OSError, UnicodeDecodeError) as error:
        raise ReportError("unreadable", f"{file}: {error}") from error
    try:
        value = strict_loads(text, unique_keys=True)
    except ValueError as error:
        raise ReportError("invalid", f"{file}: {error}") from error
    if not isinstance(value, dict) or "experiment_id" not in value or "comparison" not in value:
        raise ReportError("invalid", f"{file} isn't a report")
    if value.get("schema_version") not in (1, 2) or isinstance(value.get("schema_version"), bool):
        raise ReportError("unsupported_version", f"{file}: version {value.get('schema_version')!r}")
    return value


def pretty(value: Any) -> str:
    """JSON for people: sorted keys, two spaces."""
    try:
        return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
    except (TypeError, ValueError):
        return "This can't be shown as JSON."


def report_text(report: dict[str, Any]) -> str:
    """A report for people."""
    lines = [f"{report['name']}  {report['verdict'] or report['status']}", "", f"{'scope':<24}{'cases':>6}{'baseline':>10}{'candidate':>10}{'delta':>10}{'+':>5}{'-':>5}"]
    rows = [(r["scope"], r) for r in report["comparison"]] + [(r["label_snapshot"] or r["selector"], r) for r in report.get("slices", [])]
    lines += [f"{name:<24}{r['case_count']:>6}{r['baseline_score']:>10.6f}{r['candidate_score']:>10.6f}{r['score_delta']:>+10.6f}{r['newly_passed_count']:>5}{r['newly_failed_count']:>5}" for name, r in rows]
    lines += [""] + [v["message"] for v in report["violations"]] if report["violations"] else ["", "no violations"]
    return "\n".join(lines)
