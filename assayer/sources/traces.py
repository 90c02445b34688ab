"""Strict ingestion of JSON Lines: validation, dead letters, first-wins deduplication, counters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.json_text import canonical_dumps, strict_loads


class IngestError(ValueError):
    """A file that can't be read at all."""


@dataclass(frozen=True)
class Counters:
    read: int
    accepted: int
    invalid: int
    duplicates_skipped: int
    stored: int


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
FIELDS = ("trace_id", "timestamp", "task_type", "prompt", "response", "context", "metadata")


def parse_time(value: Any) -> datetime:
    """A moment with an offset, in UTC: ISO text, or a number of seconds (of milliseconds beyond 2e10)."""
    if isinstance(value, bool):
        raise ValueError("must be a time")
    if isinstance(value, str) and value.strip().lstrip("+-").replace(".", "", 1).isdigit():
        value = float(value)
    if isinstance(value, int | float):
        return datetime.fromtimestamp(value / 1000 if abs(value) > 2e10 else value, UTC)
    if not isinstance(value, str):
        raise ValueError("must be a time")
    found = datetime.fromisoformat(value.strip())
    if found.tzinfo is None:
        raise ValueError("must have an offset")
    return found.astimezone(UTC)


def parse_trace(line: str) -> dict[str, Any]:
    """The fields of one record; ValueError says what is wrong with the first faulty one."""
    try:
        value = strict_loads(line)
    except (ValueError, RecursionError) as error:
        raise ValueError(f"malformed JSON: {error}") from error
    if not isinstance(value, dict):
        raise ValueError("schema error: a record must be an object")
    faults: list[str] = [f"{k}: isn't known" for k in value if k not in FIELDS]
    out: dict[str, Any] = {}
    for name in ("trace_id", "task_type", "prompt"):
        out[name] = value.get(name)
        if not isinstance(out[name], str) or not out[name].strip():
            faults.append(f"{name}: must be text that isn't blank")
    if "timestamp" not in value:
        faults.append("timestamp: must be given")
    else:
        try:
            out["timestamp"] = parse_time(value["timestamp"])
        except (ValueError, OverflowError, OSError) as error:
            faults.append(f"timestamp: {error}")
    out["response"] = value.get("response")
    if out["response"] is not None and not isinstance(out["response"], str):
        faults.append("response: must be text or null")
    for name in ("context", "metadata"):
        held = value.get(name, {})
        if isinstance(held, dict):
            out[f"{name}_json"] = canonical_dumps(held)
        else:
            faults.append(f"{name}: must be an object")
    if faults:
        raise ValueError("schema error: " + "; ".join(faults))
    return out


_PARSED = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("trace_id", T.StringType()), T.StructField("timestamp", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("task_type", "prompt", "response", "context_json", "metadata_json")]
)


@F.pandas_udf(_PARSED)
def parse_lines(lines: pd.Series) -> pd.DataFrame:
    """Each line's fields, or its error; the time in microseconds, which reach every year that a record may have."""
    names = [f.name for f in _PARSED.fields]
    rows = []
    for line in lines:
        try:
            found = parse_trace(line)
            rows.append({"error": None, **found, "timestamp": (found["timestamp"] - EPOCH) // timedelta(microseconds=1)})
        except ValueError as error:
            rows.append(dict.fromkeys(names) | {"error": str(error)})
    return pd.DataFrame(rows, columns=names, dtype=object)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1.

    Lines are counted within the blocks that tasks read, and blocks are placed by their offset:
    only a row for each block is sorted.
    """
    return numbered(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def numbered(rows: DataFrame) -> DataFrame:
    """(file, line, value) of rows (file, block, value) as tasks read them: in the order of a block.

    A block's rows stand side by side in one task, so a row's place is its distance from the block's first: nothing is sorted or
    moved but a row for each block.
    """
    rows = rows.withColumn("m", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("count"), F.min("m").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("first") + 1).alias("start"))
    return rows.join(F.broadcast(starts), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", (F.col("start") + F.col("m")).alias("line"), "value")


def parsed(lines: DataFrame) -> DataFrame:
    """lines (file, line, value) with the fields of each record and error."""
    found = lines.withColumn("p", parse_lines("value")).select("file", "line", "p.*")
    return found.withColumn("timestamp", F.timestamp_micros("timestamp"))


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def rejects(rows: DataFrame) -> DataFrame:
    """Dead letters: (file, line, message)."""
    message = F.concat(F.col("file"), F.lit(": line "), F.col("line"), F.lit(": "), F.col("error"))
    return rows.filter(F.col("error").isNotNull()).select("file", "line", message.alias("message"))


def first_wins(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first row of each trace_id by file and line, without those that are stored already.

    min_by is summed before the shuffle, so a trace that repeats a million times moves once a task.
    """
    fields = [c for c in rows.columns if c not in ("file", "line", "trace_id")]
    first = rows.groupBy("trace_id").agg(F.min_by(F.struct(*fields), F.struct("file", "line")).alias("r")).select("trace_id", "r.*")
    return first if stored is None else first.join(stored.select("trace_id"), "trace_id", "left_anti")


def ingest(spark: SparkSession, path: str, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Counters]:
    """(new traces, dead letters, counters) of files of JSON Lines. Bytes that aren't UTF-8 reject the whole."""
    lines = read_lines(spark, path)
    if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        raise IngestError(f"{path} isn't UTF-8")
    rows = parsed(lines).cache()
    fresh = first_wins(valid(rows), stored).cache()
    read, bad = rows.agg(F.count("*"), F.count("error")).head()
    kept = fresh.count()
    return fresh, rejects(rows), Counters(read, read - bad, bad, read - bad - kept, kept)


def find_trace(traces: DataFrame, trace_id: str) -> DataFrame:
    """The trace of an id, or no row; the comparison reaches the scan."""
    return traces.filter(F.col("trace_id") == trace_id)


def newest_first(traces: DataFrame) -> DataFrame:
    return traces.orderBy(F.desc("timestamp"), "trace_id")


def utc_text(col: F.Column) -> F.Column:
    """Fixed-width UTC text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_PAYLOAD = ("context", "metadata", "prompt", "response", "task_type", "timestamp", "trace_id")


def payload(traces: DataFrame) -> F.Column:
    """The canonical record of a trace, for its hash."""
    from assayer.functions.json_text import fixed_object, quote

    return fixed_object(
        context=F.col("context_json"), metadata=F.col("metadata_json"), prompt=quote(F.col("prompt")), response=F.coalesce(quote(F.col("response")), F.lit("null")),
        task_type=quote(F.col("task_type")), timestamp=quote(utc_text(F.col("timestamp"))), trace_id=quote(F.col("trace_id")),
    )
