"""Queries that run the shipped sources, catalog and experiments end to end, each beside its SQL.

Records are made from the driver's tables as JSON Lines, ingested from files, and stored in a catalog
below the shared folder: traces, dead letters, slices, datasets, an experiment with fixtures. The
catalog of a table folder is built once a session, each part of it when a query first asks for it. The SQL repeats the rules over the tables.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import cached_property
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ids import dataset_id, eval_id
from assayer.functions.json_text import canonical_json, fixed_object, quote, strict_json
from assayer.functions.shared import at_once, scratch, written
from assayer.functions.text import nonblank
from assayer.operators import clustering, comparing, judging, sampling, scoring
from assayer.operators.comparing import Limits
from assayer.plans import config, constraints, export, slicing
from assayer.plans.experiment import Experiment, load_detail, load_report
from assayer.plans.log import Change
from assayer.plans.queries import _judged, _props, _trace_documents, cases, outputs, table, traces
from assayer.plans.store import Catalog
from assayer.schemas import SCORERS, schema
from assayer.sources import fixtures, http_provider
from assayer.sources.traces import find_trace, first_wins, ingest, newest_first, parsed, read_lines, utc_text, valid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its name with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- ingestion -----------------------------------------------------------------------------------

_FILES: dict[tuple[str, str], str] = {}


def event_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of four text files: a record for each event, in the order of ids; four of ten are faulty."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        e, n = table(spark, sf_dir, "events"), F.col("event_id")
        time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        fields = {"trace_id": quote(F.concat(F.lit("u"), "user_id")), "task_type": quote(F.col("event_type")), "timestamp": quote(F.concat(time, F.lit("Z")))}
        prompt = quote(F.concat(F.lit("p"), n))
        whole = fixed_object(**fields, prompt=prompt, context=F.lit('{"b":1, "a":"x"}'), response=F.when(n % 2 == 0, F.lit("null")).otherwise(quote(F.lit("r"))))
        bad = F.when(n % 10 == 0, F.concat(F.lit("{not json "), n)).when(n % 10 == 1, F.concat(F.lit("["), n, F.lit("]"))).when(n % 10 == 2, fixed_object(**fields))
        value = F.coalesce(bad.when(n % 10 == 3, fixed_object(**fields | {"timestamp": quote(time)}, prompt=prompt)), whole)
        rows = e.select((n % 4).alias("part"), n, "user_id", "event_type", "ts").repartition(4, "part").sortWithinPartitions("part", "event_id")
        path = scratch(spark, "event-lines")
        rows.select("part", value.alias("value")).write.partitionBy("part").text(path)  # sorted before the lines are made
        _FILES[key] = path
    return _FILES[key]


def _part() -> Column:
    return F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part")


LINES = """lines AS (
  SELECT *, CAST(event_id % 4 AS INT) AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS line, 'u' || user_id AS trace_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t FROM events
), texts AS (
  SELECT *, CASE event_id % 10 WHEN 0 THEN '{not json ' || event_id WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '{"task_type":"' || event_type || '","timestamp":"' || t || 'Z","trace_id":"' || trace_id || '"}'
    WHEN 3 THEN '{"prompt":"p' || event_id || '","task_type":"' || event_type || '","timestamp":"' || t || '","trace_id":"' || trace_id || '"}'
    ELSE '{"context":{"b":1, "a":"x"},"prompt":"p' || event_id || '","response":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"r"' END || ',"task_type":"' || event_type || '","timestamp":"' || t || 'Z","trace_id":"' || trace_id || '"}' END AS body
  FROM lines
), good AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, line) AS place FROM texts WHERE event_id % 10 > 3)"""
STORED = "user_id % 3 = 0"


@query(f"WITH {LINES} SELECT part, line, sha256(body) AS line_hash FROM texts")
def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: physical lines of text files, counted from 1."""
    return read_lines(spark, event_lines(spark, sf_dir)).select(_part(), F.col("line").cast("long").alias("line"), F.sha2("value", 256).alias("line_hash"))


@query(f"""WITH {LINES} SELECT count(*) AS read, count(*) FILTER (event_id % 10 > 3) AS accepted, count(*) FILTER (event_id % 10 <= 3) AS invalid,
  count(*) FILTER (event_id % 10 > 3) - count(DISTINCT CASE WHEN event_id % 10 > 3 THEN user_id END) AS duplicates_skipped, count(DISTINCT CASE WHEN event_id % 10 > 3 THEN user_id END) AS stored FROM texts""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: lines read, accepted, invalid, duplicates and stored, as ingest() counts them."""
    counters = ingest(spark, event_lines(spark, sf_dir))[2]
    return spark.createDataFrame([tuple(counters.__dict__.values())], "read long, accepted long, invalid long, duplicates_skipped long, stored long")


@query(f"""WITH {LINES} SELECT part, line, CASE event_id % 10 WHEN 0 THEN 'malformed JSON' WHEN 1 THEN 'schema error: a record must be an object' WHEN 2 THEN 'schema error: prompt: must be text that isn''t blank'
  ELSE 'schema error: timestamp: must have an offset' END AS message FROM texts WHERE event_id % 10 <= 3""")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: dead letters of ingest(), with the rule that each breaks; of malformed JSON without Python's words."""
    bad = ingest(spark, event_lines(spark, sf_dir))[1]
    said = F.regexp_replace("message", r"^.*: line \d+: ", "")
    return bad.select(_part(), F.col("line").cast("long").alias("line"), F.when(said.startswith("malformed JSON"), "malformed JSON").otherwise(said).alias("message"))


@query(f"""WITH {LINES} SELECT trace_id, t || 'Z' AS timestamp, event_type AS task_type, 'p' || event_id AS prompt, CASE WHEN event_id % 2 = 1 THEN 'r' END AS response, '{{"a":"x","b":1}}' AS context_json, '{{}}' AS metadata_json FROM good WHERE place = 1""")
def ingested_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingest() stores: the first valid record of each trace by file and line."""
    rows = ingest(spark, event_lines(spark, sf_dir))[0]
    return rows.withColumn("timestamp", utc_text(F.col("timestamp"))).select("trace_id", "timestamp", "task_type", "prompt", "response", "context_json", "metadata_json")


@query(f"WITH {LINES} SELECT trace_id, 'p' || event_id AS prompt FROM good WHERE place = 1 AND NOT ({STORED})")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_wins() against what is stored already."""
    rows = valid(parsed(read_lines(spark, event_lines(spark, sf_dir))))
    stored = table(spark, sf_dir, "events").filter(STORED).select(F.concat(F.lit("u"), "user_id").alias("trace_id"))
    return first_wins(rows, stored).select("trace_id", "prompt")


@query(f"WITH {LINES} SELECT trace_id, t || 'Z' AS timestamp FROM good WHERE place = 1 ORDER BY ts DESC, trace_id")
def newest_first_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored traces, newest first, ties by id."""
    return newest_first(ingest(spark, event_lines(spark, sf_dir))[0]).select("trace_id", utc_text(F.col("timestamp")).alias("timestamp"))


@query("SELECT event_id, json_valid(output) AS valid, CASE WHEN json_valid(output) THEN json_type(output) = 'OBJECT' ELSE false END AS is_object, CASE WHEN NOT json_valid(output) THEN NULL WHEN json_type(output) = 'OBJECT' THEN '{\"k\":' || json_extract_string(output, '$.k') || '}' END AS canonical FROM (SELECT event_id, CASE event_id % 10 WHEN 0 THEN props || '}' WHEN 1 THEN '{not json' WHEN 2 THEN '[' || props || ']' ELSE props END AS output FROM events)")
def strict_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict decoding and the canonical form of objects."""
    rows = _props(spark, sf_dir).withColumn("j", strict_json("output"))
    return rows.select("event_id", "j.valid", "j.is_object", F.when(F.col("j.is_object"), canonical_json("output")).alias("canonical"))


# --- a catalog and an experiment ---------------------------------------------------------------------

_STORES: dict[tuple[str, str], Stored] = {}
SLICES, PICKED = 5, 20
THRESHOLD = 0.7


class Stored:
    """The catalog of a table folder's conversations: their traces, and what is made of these when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.store = Catalog(spark, scratch(spark, "catalog"))

    @cached_property
    def catalog(self) -> Catalog:
        """The catalog with all traces."""
        spark = self.spark
        line = fixed_object(trace_id=quote(F.col("trace_id")), timestamp=F.lit('"2026-01-01T00:00:00Z"'), task_type=F.lit('"chat"'), prompt=quote(F.col("prompt")), response=F.coalesce(quote(F.col("response")), F.lit("null")))
        lines = scratch(spark, "talk-lines")
        traces(spark, self.sf_dir).select(line.alias("value")).write.text(lines)
        self.store.commit("traces", ingest(spark, lines, self.store.read("traces"))[0])
        return self.store

    @cached_property
    def run(self) -> str:
        """A clustering run of all traces, one of whose slices was renamed."""
        made = slicing.cluster_traces(self.catalog, "talks", SLICES)
        self.catalog.rename_slice(made, 0, " First ")
        return made

    @cached_property
    def sliced(self) -> str:
        """A sealed dataset of the run's slices."""
        return slicing.build_from_slices(self.catalog, self.run, "sliced", "1", PICKED, fixtures.read_overrides(self.spark, None))

    @cached_property
    def dataset(self) -> str:
        """A dataset of all cases."""
        made = self.store.create_dataset("talks", "1")
        mode = F.col("evaluation_mode")
        answer = F.when(mode == "reference", F.col("response"))
        exact = F.array(F.struct(F.lit("exact_match").alias("name"), fixed_object(expected=quote(F.col("response"))).alias("config")))
        held = cases(self.spark, self.sf_dir).select(
            eval_id(F.lit(made), F.col("source_trace_id")).alias("eval_id"), F.lit(made).alias("dataset_id"), "source_trace_id", "evaluation_mode", "priority", F.lit("draft").alias("review_status"), F.lit("chat").alias("task_type"), "prompt",
            F.lit("{}").alias("context_json"), F.when(mode == "deterministic", exact).alias("scorers"), F.when(mode == "rubric", F.array(F.lit("clear"), F.lit("kind"))).alias("rubric"), answer.alias("reference_answer"), answer.alias("source_response"),
        )
        self.store.add_cases(made, held)
        return made

    @cached_property
    def experiment(self) -> str:
        """An experiment over the dataset of all cases."""
        home = scratch(self.spark, "fixtures")
        catalog, *_ = at_once(self.spark, lambda: self.catalog, lambda: self.dataset, lambda: _fixtures(home, dataset_id("talks", "1"), cases(self.spark, self.sf_dir)))
        return _experiment(catalog, home)


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = Stored(spark, sf_dir)
    return _STORES[key]


def _fixtures(home: str, dataset: str, made: DataFrame) -> None:
    """Writes the fixture files of an experiment, on executors."""
    name = eval_id(F.lit(dataset), F.col("source_trace_id")).alias("eval_id")
    score = ((F.col("conv_id") * 3 + F.col("turn") + F.when(F.col("role") == "baseline", 0).otherwise(2)) % 5) / F.lit(4.0)
    held = outputs(made).select("role", name, "output", "evaluation_mode", score.alias("s"))
    line = fixed_object(eval_id=quote(F.col("eval_id")), output=quote(F.col("output")))
    written_by = [lambda role=role: held.filter(F.col("role") == role).select(line.alias("value")).write.text(f"{home}/{role}") for role in comparing.ROLES]
    answer = _answers(F.col("s"))
    listed = F.when(F.col("s") == 0, F.concat(F.lit('["broken",'), quote(answer), F.lit("]"))).otherwise(F.concat(F.lit("["), quote(answer), F.lit("]")))
    judged = held.filter("evaluation_mode = 'rubric'").select(fixed_object(eval_id=quote(F.col("eval_id")), role=quote(F.col("role")), outputs=listed).alias("value"))
    at_once(made.sparkSession, *written_by, lambda: judged.write.text(f"{home}/judge"))


def _experiment(c: Catalog, home: str) -> str:
    """Runs an experiment over fixture files."""
    with tempfile.TemporaryDirectory() as folder:  # the configuration is the driver's own
        file = Path(folder) / "config.yaml"
        file.write_text(re.sub(r"path: (\w+)", rf"path: '{home}/\1'", CONFIG), "utf-8")
        return Experiment(c, config.load_config(str(file))).run()


@F.pandas_udf(T.StringType())
def _answers(scores: pd.Series) -> pd.Series:
    """A judge's response by a score of both criteria."""
    return scores.map(lambda s: judging.response([(k, s, s >= 0.5, "because") for k in ("clear", "kind")], 0.2 + s / 2))


CONFIG = """schema_version: 1
name: talks
dataset: talks:1
baseline: {provider: fixture, path: baseline}
candidate: {provider: fixture, path: candidate}
judge: {provider: fixture, path: judge, confidence_threshold: 0.7}
gate: {max_score_drop: 0.01, max_new_failures: 5, by_mode: {rubric: {max_score_drop: 0.02}}}
"""


def _mine(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The experiment's rows of a table, with the trace of each case."""
    held = stored(spark, sf_dir)
    experiment, c = held.experiment, held.catalog
    rows = c.read(name).filter(F.col("experiment_id") == experiment)
    if "eval_id" not in rows.columns:
        return rows
    return rows.join(c.read("cases").filter(F.col("dataset_id") == held.dataset).select("eval_id", F.col("source_trace_id").alias("trace_id")), "eval_id")


def _views() -> str:
    from assayer.plans.oracle import VIEWS

    return VIEWS


V = f"WITH {_views()}"


@query(f"{V} SELECT trace_id, sha256(prompt) AS prompt_hash, sha256(response) AS response_hash FROM traces ORDER BY trace_id")
def stored_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of stored traces in the order of ids."""
    return stored(spark, sf_dir).catalog.read("traces").orderBy("trace_id").select("trace_id", F.sha2("prompt", 256).alias("prompt_hash"), F.sha2("response", 256).alias("response_hash"))


@query(f"{V} SELECT trace_id, prompt, response FROM traces WHERE trace_id = 'c1-0'")
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored trace by its id."""
    return find_trace(stored(spark, sf_dir).catalog.read("traces"), "c1-0").select("trace_id", "prompt", "response")


@query(f"{V} SELECT trace_id, row_number() OVER (ORDER BY trace_id) - 1 AS document_index, sha256(prompt) AS document_hash, prompt FROM traces")
def assigned_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with their traces, by document_index."""
    held = stored(spark, sf_dir)
    return slicing.assigned(held.catalog, held.run).select("trace_id", "document_index", "document_hash", "prompt")


MARKED = f"""{V}, placed AS (SELECT trace_id, conv_id, row_number() OVER (ORDER BY trace_id) - 1 AS place FROM traces),
  held AS (SELECT *, place + CASE WHEN conv_id % 4 = 1 THEN 2 ELSE 0 END AS document_index, CASE WHEN conv_id % 11 = 3 THEN 9 ELSE place % 4 END AS cluster_number, row_number() OVER (ORDER BY trace_id) - 1 AS right_place FROM placed WHERE conv_id % 7 <> 0)"""
_MARKED: dict[tuple[str, str], Catalog] = {}


def _marked(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog with a run "marked" that a program other than ours spoiled: rows lost, hashes, indexes and slices changed, times gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MARKED:
        c = Catalog(spark, scratch(spark, "marked"))
        talks = traces(spark, sf_dir)
        time = F.when(F.col("conv_id") % 13 != 5, F.lit("2026-01-01").cast("timestamp"))
        c.commit("traces", talks.withColumns({"timestamp": time, "task_type": F.lit("chat"), "context_json": F.lit("{}"), "metadata_json": F.lit("{}")}))
        n = F.col("conv_id")
        hashed = slicing._hashed(c.read("traces")).select("trace_id", "document_hash", "source_trace_hash").join(talks.select("trace_id", "conv_id"), "trace_id")
        placed = clustering.document_index(hashed).filter(n % 7 != 0)
        number = F.when(n % 11 == 3, 9).otherwise(F.col("document_index") % 4)
        spoiled = placed.select(F.lit("marked").alias("clustering_run_id"), "trace_id", (F.col("document_index") + F.when(n % 4 == 1, 2).otherwise(0)).alias("document_index"), number.alias("cluster_number"), "document_hash", F.when(n % 5 != 1, F.col("source_trace_hash")).alias("source_trace_hash"))
        now = datetime(2026, 1, 1, tzinfo=UTC)
        with c.change() as change:
            change.add("cluster_assignments", spoiled)
            change.put("cluster_labels", [{"clustering_run_id": "marked", "cluster_number": i, "label": None, "label_key": None, "version": 0, "updated_at": now} for i in range(5)])
            change.put("clustering_runs", [{"clustering_run_id": "marked", "name": "marked", "configuration_hash": "c", "source_manifest_hash": "s", "trace_count": talks.count(), "cluster_count": 5, "inertia": 0.0, "created_at": now}])
        c.rename_slice("marked", 1, " Second ")
        c.rename_slice("marked", 1, "Second half")
        _MARKED[key] = c
    return _MARKED[key]


@query(f"""{MARKED} SELECT 'assignments' AS fault, (SELECT count(*) FROM placed) - count(*) AS n FROM held UNION ALL SELECT 'changed', count(*) FROM held WHERE conv_id % 5 = 1 AND conv_id % 13 <> 5
  UNION ALL SELECT 'foreign_times', count(*) FROM held WHERE conv_id % 13 = 5 UNION ALL SELECT 'gaps', count(*) FROM held WHERE document_index <> right_place
  UNION ALL SELECT 'slices', 5 - count(DISTINCT cluster_number) FILTER (cluster_number < 5) + count(*) FILTER (cluster_number > 4) FROM held""")
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoiled clustering run against its traces: counts, hashes, times, contiguous indexes, slices."""
    return slicing.snapshot_faults(_marked(spark, sf_dir), "marked")


@query(f"{V} SELECT unnest(['assignments', 'changed', 'foreign_times', 'gaps', 'slices']) AS fault, CAST(0 AS BIGINT) AS n")
def sound_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that cluster_traces() stored has none of the faults that snapshot_integrity finds."""
    held = stored(spark, sf_dir)
    return slicing.snapshot_faults(held.catalog, held.run)


@query(f"{MARKED}, sizes AS (SELECT cluster_number AS c, count(*) AS k FROM held GROUP BY 1) SELECT CAST(n AS INT) AS cluster_number, CASE WHEN n = 1 THEN 'Second half' END AS label, CASE WHEN n = 1 THEN 2 ELSE 0 END AS version, coalesce(k, 0) AS trace_count FROM range(5) AS r(n) LEFT JOIN sizes ON c = n")
def labeled_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each slice's label, and how many traces each slice has, none too."""
    c = _marked(spark, sf_dir)
    versions = c.labels("marked").select("cluster_number", F.col("version").cast("int").alias("version"))
    return c.slices("marked").join(versions, "cluster_number").select("cluster_number", "label", "version", "trace_count")


@query(f"{V} SELECT CAST(n AS INT) AS cluster_number, CASE WHEN n = 0 THEN 'First' END AS label, CASE WHEN n = 0 THEN 1 ELSE 0 END AS version, true AS filled, (SELECT count(*) FROM traces) AS all_traces FROM range({SLICES}) AS r(n)")
def stored_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of a clustering run after one was renamed, and the sum of their sizes."""
    held = stored(spark, sf_dir)
    run, c = held.run, held.catalog
    constraints.check_empty(constraints.label_updates(c.read("cluster_labels")), "label versions")
    sizes = c.slices(run)
    total = sizes.agg(F.sum("trace_count").cast("long").alias("all_traces"))
    versions = c.labels(run).select("cluster_number", F.col("version").cast("int").alias("version"))
    filled = (F.col("trace_count") > 0).alias("filled")
    return sizes.join(versions, "cluster_number").crossJoin(F.broadcast(total)).select("cluster_number", "label", "version", filled, "all_traces")


@query(f"""{V} SELECT 'talks-' || conv_id AS name, count(*) AS case_count, count(*) AS provenance_count, true AS sealed FROM traces WHERE conv_id < 6 AND conv_id % 3 <> 1 GROUP BY conv_id""")
def committed_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of six conversations, a third of whose writers died before their record was put.

    A dataset, its cases, their provenance and its seal are there together or not at all.
    """
    c, now = Catalog(spark, scratch(spark, "builds")), datetime(2026, 1, 1, tzinfo=UTC)
    talks = traces(spark, sf_dir).filter("conv_id < 6").select("trace_id", "conv_id", "prompt", "response").cache()
    for n in [r[0] for r in talks.select("conv_id").distinct().orderBy("conv_id").collect()]:
        name, mine = f"talks-{n}", talks.filter(F.col("conv_id") == n)
        made = dataset_id(name, "1")
        key = eval_id(F.lit(made), F.col("trace_id")).alias("eval_id")
        answer = F.coalesce("response", F.lit("none"))
        held = mine.select(key, F.lit(made).alias("dataset_id"), F.col("trace_id").alias("source_trace_id"), F.lit("reference").alias("evaluation_mode"), F.lit("medium").alias("priority"), F.lit("draft").alias("review_status"), F.lit("chat").alias("task_type"), "prompt", F.lit("{}").alias("context_json"), answer.alias("reference_answer"), answer.alias("source_response"), F.lit(None).cast(SCORERS).alias("scorers"), F.lit(None).cast("array<string>").alias("rubric"))
        size = held.count()
        build = spark.createDataFrame([(made, "run", size, "m", "c", "s", now)], schema("slice_builds"))
        change = Change(c.log)
        c.create_dataset(name, "1", within=change)
        c.seal(made, held, mine.select(key, F.lit(made).alias("dataset_id"), "trace_id"), build, change)
        if n % 3 != 1:  # the others stop here: their folders are written, and no record names them
            change.commit()
    talks.unpersist()
    counted = c.read("slice_provenance").groupBy("dataset_id").agg(F.count("*").alias("provenance_count"))
    sealed = c.read("slice_builds").select("dataset_id", F.lit(True).alias("sealed"))
    return c.datasets().join(counted, "dataset_id", "left").join(sealed, "dataset_id", "left").select("name", "case_count", "provenance_count", "sealed")


@query("SELECT CAST(user_id AS VARCHAR) AS cache_key, 1::BIGINT AS entries, true AS held FROM events GROUP BY user_id")
def racing_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers at once store their answers for the same users: one entry a key, one of the answers given."""
    root = scratch(spark, "race")
    Catalog(spark, root)
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache_key")).distinct().cache()

    def write(i: int) -> None:
        rows = users.select("cache_key", F.lit("{}").alias("identity_json"), F.lit(f"answer of {i}").alias("raw_response"), F.current_timestamp().alias("written_at"))
        with Catalog(spark, root).change() as change:
            change.first("judge_cache", "cache_key", rows)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    users.unpersist()
    stored_rows = Catalog(spark, root).read("judge_cache").groupBy("cache_key")
    return stored_rows.agg(F.count("*").alias("entries"), F.bool_and(F.col("raw_response").rlike("^answer of [0-3]$")).alias("held"))


@query(f"{V} SELECT 'sliced' AS name, '1' AS version, {PICKED} AS case_count UNION ALL SELECT 'talks', '1', count(*) FROM cases")
def dataset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of the catalog with their numbers of cases."""
    held = stored(spark, sf_dir)
    _ = held.sliced, held.dataset  # both are in the list
    return held.catalog.datasets().select("name", "version", "case_count")


@query(f"{V} SELECT role, trace_id, evaluation_mode, score, passed FROM results")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored results of both runs of the experiment, by the runs' ids."""
    held = stored(spark, sf_dir)
    experiment, c = held.experiment, held.catalog
    runs = [r.run_id for r in c.read("runs").filter(F.col("experiment_id") == experiment).collect()]  # two
    rows = _mine(spark, sf_dir, "case_results").filter(F.col("run_id").isin(*runs)).drop("role").join(c.read("runs").select("run_id", "role"), "run_id")
    return rows.select("role", "trace_id", "evaluation_mode", "score", "passed")


@query(f"{V} SELECT trace_id, c.evaluation_mode, baseline_score, candidate_score, score_delta, transition FROM cmp AS c JOIN cases USING (eval_id)")
def stored_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored comparison of each case."""
    return _mine(spark, sf_dir, "case_comparisons").select("trace_id", "evaluation_mode", "baseline_score", "candidate_score", "score_delta", "transition")


@query(f"""{V}, j AS (SELECT *, score AS s FROM results WHERE evaluation_mode = 'rubric')
  SELECT role, trace_id, CASE WHEN s = 0 THEN 2 ELSE 1 END AS attempts, s AS score, s >= 0.5 AS passed, round(0.2 + s / 2, 6) AS confidence, 'miss' AS cache_status,
    CASE WHEN 0.2 + s / 2 < {THRESHOLD} OR (priority = 'critical' AND s < 0.5) THEN 'needs_review' ELSE 'not_required' END AS review_status FROM j""")
def stored_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge results with the lookups of the same run and case."""
    looked = _mine(spark, sf_dir, "judge_lookups").select("run_id", "eval_id", "cache_status")
    rows = _mine(spark, sf_dir, "judge_results").drop("cache_status").join(looked, ["run_id", "eval_id"])
    return rows.select("role", "trace_id", "attempts", F.col("overall_score").alias("score"), "passed", F.round("confidence", 6).alias("confidence"), "cache_status", "review_status")


@query(f"""{V} SELECT role, trace_id, CAST(i AS INT) AS scorer_index, CASE WHEN evaluation_mode = 'rubric' THEN 'rubric' ELSE 'exact_match' END AS name, score, passed
  FROM results, range(2) AS r(i) WHERE i = 0 OR evaluation_mode = 'rubric'""")
def stored_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results of scorers and criteria with their places."""
    rows = _mine(spark, sf_dir, "scorer_results")
    return rows.join(stored(spark, sf_dir).catalog.read("runs").select("run_id", "role"), "run_id").select("role", "trace_id", "scorer_index", "name", "score", "passed")


def _reported() -> str:
    from assayer.plans.oracle import AGGREGATES

    return f"{V}, {AGGREGATES}"


@query(f"""{_reported()} SELECT scope, case_count, round(baseline_score, 6) AS baseline_score, round(candidate_score, 6) AS candidate_score, newly_passed_count, newly_failed_count FROM agg""")
def report_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes of a report that was exported and read back."""
    held = stored(spark, sf_dir)
    experiment, c = held.experiment, held.catalog
    with tempfile.TemporaryDirectory() as folder:
        export.export_report(load_report(c, experiment), f"{folder}/report.json")
        report = export.read_report(f"{folder}/report.json")
    assert report["name"] in export.report_text(report)
    rows = [(r["scope"], r["case_count"], round(r["baseline_score"], 6), round(r["candidate_score"], 6), r["newly_passed_count"], r["newly_failed_count"]) for r in report["comparison"]]
    return spark.createDataFrame(rows, "scope string, case_count long, baseline_score double, candidate_score double, newly_passed_count long, newly_failed_count long")


@query(f"""{V} SELECT transition, trace_id FROM cmp JOIN cases USING (eval_id) WHERE transition IN ('newly_passed', 'newly_failed')""")
def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that a report lists as newly passed and newly failed."""
    held = stored(spark, sf_dir)
    experiment, dataset, c = held.experiment, held.dataset, held.catalog
    report = load_report(c, experiment)
    rows = spark.createDataFrame([(k, e) for k in ("newly_passed", "newly_failed") for e in report.get(k, [])], "transition string, eval_id string")
    return rows.join(c.read("cases").filter(F.col("dataset_id") == dataset).select("eval_id", F.col("source_trace_id").alias("trace_id")), "eval_id").select("transition", "trace_id")


@query(f"""{V} SELECT c.trace_id, 'Unassigned' AS slice_label, c.priority, b.output AS baseline_output, d.output AS candidate_output, transition FROM cases AS c
  JOIN results AS b ON b.eval_id = c.eval_id AND b.role = 'baseline' JOIN results AS d ON d.eval_id = c.eval_id AND d.role = 'candidate' JOIN cmp ON cmp.eval_id = c.eval_id""")
def stored_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail of an experiment from its stored rows, after its coverage is checked."""
    held = stored(spark, sf_dir)
    experiment, c = held.experiment, held.catalog
    return load_detail(c, experiment).select(F.col("source_trace_id").alias("trace_id"), "slice_label", "priority", "baseline_output", "candidate_output", "transition")


@query(f"""{V} SELECT CAST(place AS BIGINT) AS place, record_type, source_trace_id, evaluation_mode, has_answer FROM (
  SELECT 0 AS place, 'dataset' AS record_type, NULL AS source_trace_id, NULL AS evaluation_mode, false AS has_answer
  UNION ALL SELECT row_number() OVER (ORDER BY {{id}}), 'case', trace_id, evaluation_mode, evaluation_mode = 'reference' FROM (
    SELECT *, sha1(unhex('{{ns}}') || encode('["' || '{{dataset}}' || '","' || trace_id || '"]')) AS h FROM cases))""")
def exported_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an exported dataset: its envelope, then cases by id; only references carry answers."""
    held = stored(spark, sf_dir)
    rows = []
    for i, line in enumerate(export.dataset_lines(held.catalog, held.dataset)):
        value = json.loads(line)
        rows.append((i, value["record_type"], value.get("source_trace_id"), value.get("evaluation_mode"), "reference_answer" in value or "source_response" in value))
    return spark.createDataFrame(rows, "place long, record_type string, source_trace_id string, evaluation_mode string, has_answer boolean")


def _with_dataset(sql: str) -> str:
    from assayer.functions.ids import CASE_NAMESPACE, dataset_id
    from assayer.plans.oracle import EVAL_ID

    return sql.replace("{id}", EVAL_ID).replace("{ns}", CASE_NAMESPACE.replace("-", "")).replace("{dataset}", dataset_id("talks", "1"))


SQL["exported_dataset"] = _with_dataset(SQL["exported_dataset"])

REFUSED = {
    "a case in a sealed dataset": "StoreError", "a commit's name again": "StoreError", "a dataset again": "StoreError", "a dataset that isn't there": "StoreError", "a label of another slice": "StoreError", "a reference without a version": "StoreError",
    "a run from completed to running": "StoreError", "a trace twice": "ConstraintError", "an override that isn't used": "StoreError", "limits of a mode without cases": "ConfigError", "more clusters than traces": "ClusteringError",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in REFUSED.items()) + ") AS t(what, error)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog refuses, and how."""
    held = stored(spark, sf_dir)
    run, _, experiment, dataset, c = held.run, held.sliced, held.experiment, held.dataset, held.catalog
    sealed = c.find_dataset(" sliced : 1 ")
    one = c.read("cases").filter(F.col("dataset_id") == dataset).limit(1)
    unused = spark.createDataFrame([("nobody", "reference", None, None, None, None)], fixtures.OVERRIDES)
    ended = c.read("run_events").filter((F.col("experiment_id") == experiment) & (F.col("status") == "completed")).head().run_id

    def absent_mode() -> None:
        wrong = config.Config("x", "sliced:1", {}, by_mode={"rubric": Limits(0.1, 1)})
        Experiment(c, wrong).prepare()

    tries = {
        "a case in a sealed dataset": lambda: c.add_cases(sealed, one), "a commit's name again": lambda: c.commit("datasets", c.read("datasets"), dataset), "a dataset again": lambda: c.create_dataset("talks", "1"), "a dataset that isn't there": lambda: c.find_dataset("talks:2"),
        "a label of another slice": lambda: c.rename_slice(run, 1, "FIRST"), "a reference without a version": lambda: c.find_dataset("talks"), "a run from completed to running": lambda: c.move("run_events", "run_id", ended, "running"),
        "a trace twice": lambda: c.add_cases(dataset, one), "an override that isn't used": lambda: slicing.build_from_slices(c, run, "other", "1", 5, unused), "limits of a mode without cases": absent_mode, "more clusters than traces": lambda: slicing.cluster_traces(c, "many", 10**9),
    }
    rows = []
    for what, attempt in tries.items():
        try:
            attempt()
        except ValueError as error:
            rows.append((what, type(error).__name__))
    return spark.createDataFrame(rows, "what string, error string")


# --- constraints ---------------------------------------------------------------------------------------


def _spectrum(wanted: int, held: int, rounds: int) -> str:
    """SQL of the first singular values of v (item_id, term, weight): rounds of products of the Gram matrix with
    held lists of numbers, made orthogonal in their order each time."""
    product = lambda v: f"list_transform(m, lambda r: list_inner_product(r, {v}))"
    minus = lambda v, u: f"list_transform(list_zip({v}, {u}), lambda z: z[1] - list_inner_product({v}, {u}) * z[2])"
    names = [f"v{i}" for i in range(held)]
    step = "SELECT n, m, " + ", ".join(f"{product(v)} AS {v}" for v in names) + " FROM it, gram"
    for i, v in enumerate(names):
        for u in names[:i]:
            step = f"SELECT * REPLACE ({minus(v, u)} AS {v}) FROM ({step})"
        step = f"SELECT * REPLACE (list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v}))) AS {v}) FROM ({step})"
    begin = ", ".join(f"list_transform(range(len(m)), lambda i: sin({i + 2}.0 * i * i + {i}.5)) AS v{i}" for i in range(held))
    found = " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS component, round(sqrt(list_inner_product(v{i}, {product(f'v{i}')})), 6) AS singular_value FROM last, gram" for i in range(wanted))
    return f""", places AS (SELECT DISTINCT item_id FROM v), dots AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.weight * b.weight) AS s FROM v AS a JOIN v AS b USING (term) GROUP BY ALL),
    rows AS (SELECT a.item_id AS i, list(coalesce(s, 0.0) ORDER BY b.item_id) AS r FROM places AS a CROSS JOIN places AS b LEFT JOIN dots ON dots.i = a.item_id AND dots.j = b.item_id GROUP BY a.item_id),
    gram AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM rows), it AS (SELECT 0 AS n, {begin} FROM gram UNION ALL SELECT n + 1, {", ".join(names)} FROM ({step}) WHERE n < {rounds}),
    last AS (SELECT * FROM it WHERE n = {rounds}) {found}"""


def _components_sql() -> str:
    from assayer.plans.oracle import TRACE_TERMS

    return "WITH RECURSIVE" + TRACE_TERMS.strip().removeprefix("WITH") + _spectrum(COMPONENTS, COMPONENTS + 2, 400)


COMPONENTS = 4


@query(_components_sql())
def trace_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the first singular values of the weights of all traces; rows in these directions have norm 1 (K4)."""
    rows = _trace_documents(spark, sf_dir)
    vectors, terms = clustering.sparse_vectors(written(clustering.tfidf(rows, "trace_id", "document"), "trace-weights"), rows.select(F.col("trace_id").alias("id")))
    made, values = clustering.decomposed(vectors, terms, COMPONENTS)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    constraints.check_empty(made.filter((F.abs(norm - 1) > 1e-9) & (norm > 0)), "rows of another norm")
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "component int, singular_value double")


def _builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("eval_id"))
    builds = items.groupBy("dataset_id").agg(F.max("eval_id").cast("long").alias("sampled_size"))
    return constraints.incomplete_builds(builds, items, items.filter("dataset_id % 3 != 0 or eval_id != 2"))


@query("""SELECT l_orderkey AS dataset_id, CAST(max(l_linenumber) AS BIGINT) AS sampled_size FROM lineitem GROUP BY l_orderkey
  HAVING count(DISTINCT l_linenumber) <> max(l_linenumber) OR count(DISTINCT CASE WHEN l_orderkey % 3 <> 0 OR l_linenumber <> 2 THEN l_linenumber END) <> max(l_linenumber)""")
def seal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds without as many cases and provenance as were sampled."""
    return _builds(spark, sf_dir).select("dataset_id", "sampled_size")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 3 <> 0 AND event_id % 5 = 0 AND event_id % 7 <> 0
  WHEN 1 THEN event_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 WHEN 2 THEN event_id % 3 = 0 AND event_id % 5 = 0 AND event_id % 7 = 0 ELSE false END AS experiment_holds,
  CASE event_id % 6 WHEN 0 THEN event_id % 11 <> 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 WHEN 1 THEN event_id % 11 = 0 AND event_id % 3 <> 0 AND event_id % 7 <> 0 WHEN 2 THEN event_id % 11 = 0 AND event_id % 3 = 0 AND event_id % 7 <> 0
  WHEN 3 THEN event_id % 11 = 0 AND event_id % 3 = 0 AND event_id % 7 = 0 WHEN 4 THEN event_id % 11 <> 0 AND event_id % 3 = 0 AND event_id % 7 <> 0 ELSE false END AS run_holds FROM events""")
def state_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which combinations of a status and its columns are legal, for experiments and runs."""
    n, some = F.col("event_id"), lambda d: F.when(F.col("event_id") % d == 0, F.lit("x"))
    pick = lambda names, d: F.element_at(F.array(*map(F.lit, names)), (n % d + 1).cast("int"))
    held = table(spark, sf_dir, "events").select(n, pick(("running", "completed", "failed", "other"), 4).alias("status"), some(3).alias("completed_at"), F.when(n % 5 != 0, F.lit("PASS")).alias("verdict"), some(7).alias("failure_stage"), some(7).alias("failure_message"), some(11).alias("started_at"), pick(("pending", "running", "completed", "failed", "skipped", "other"), 6).alias("run_status"))
    first = held.withColumn("experiment_holds", constraints.experiment_state())
    return first.withColumn("status", F.col("run_status")).withColumn("run_holds", constraints.run_state()).select("event_id", "experiment_holds", "run_holds")


@query("""SELECT event_id, event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 AS rubric_holds, event_id % 6 <> 0 AND event_id % 7 <> 0 AS scorers_hold FROM events""")
def list_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria that are filled and differ, scorers of a name and an object each."""
    n = F.col("event_id")
    rubric = F.array(F.lit("clear"), F.when(n % 3 == 0, F.lit(" clear ")).when(n % 4 == 0, F.lit(" \t")).otherwise(F.lit("kind")), F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("short")))
    scorers = F.array(F.struct(F.when(n % 6 == 0, F.lit(" ")).otherwise(F.lit("regex")).alias("name"), F.when(n % 7 == 0, F.lit("[]")).otherwise(F.lit(' {"pattern":"x"}')).alias("config")))
    rows = table(spark, sf_dir, "events").select("event_id", rubric.alias("rubric"), scorers.alias("scorers"))
    return rows.select("event_id", constraints.rubric_list().alias("rubric_holds"), constraints.scorer_list().alias("scorers_hold"))


@query(r"""SELECT doc_id, length(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AS filled, doc_id % 4 <> 0 AS hash_holds, coalesce(lang IN ('en', 'de'), false) AND false AS mode_holds,
  doc_id % 5 IN (0, 1, 2) AS share_holds FROM documents""")
def column_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled texts, hexadecimal hashes, names of a list, shares."""
    n = F.col("doc_id")
    digest = F.sha2(n.cast("string"), 256)
    share = F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.25), F.lit(1.5), F.lit(float("nan"))), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(nonblank(F.col("text")), F.lit(False)).alias("filled"), constraints.is_hash(F.when(n % 4 == 0, F.upper(F.concat(digest, F.lit("")))).otherwise(digest)).alias("hash_holds"), constraints.is_code(F.col("lang"), "evaluation_mode").alias("mode_holds"), constraints.is_share(share).alias("share_holds"))


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type FROM events),
  w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY version) AS before FROM v) SELECT CAST(user_id AS VARCHAR) AS clustering_run_id, version FROM w WHERE version > 1 AND event_type IS NOT DISTINCT FROM before""")
def label_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of labels that change nothing; a user's events stand for the versions of a slice."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clustering_run_id"), F.lit(0).alias("cluster_number"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("version"), F.col("event_type").alias("label"), F.col("event_type").alias("label_key"), F.lit(None).cast("timestamp").alias("updated_at"))
    return constraints.label_updates(rows).select("clustering_run_id", "version")


# --- coverage, judging, overrides ---------------------------------------------------------------------------


@query(f"""{V} SELECT 'missing' AS kind, eval_id FROM cases WHERE conv_id % 5 = 2 UNION ALL SELECT 'unknown', 'e-' || trace_id FROM traces WHERE trace_id NOT IN (SELECT trace_id FROM cases)""")
def coverage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without an output, outputs of no case."""
    rows = cases(spark, sf_dir)
    found = rows.filter("conv_id % 5 != 2").select("eval_id").unionByName(traces(spark, sf_dir).join(rows.select(F.col("source_trace_id").alias("trace_id")), "trace_id", "left_anti").select(F.concat(F.lit("e-"), "trace_id").alias("eval_id")))
    return fixtures.coverage_faults(rows.select("eval_id"), found, ["eval_id"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat."""
    return constraints.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(f"{V} SELECT role, eval_id FROM results WHERE evaluation_mode = 'rubric'")
def expected_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rubric case in both roles."""
    return fixtures.expected_judgments(cases(spark, sf_dir))


@query(f"{V} SELECT trace_id AS source_trace_id FROM traces WHERE conv_id % 3 = 1 AND conv_id % 2 = 1")
def unused_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of traces that weren't selected."""
    rows = traces(spark, sf_dir)
    return sampling.unused_overrides(rows.filter("conv_id % 3 = 1").select(F.col("trace_id").alias("source_trace_id")), rows.filter("conv_id % 2 = 0")).select("source_trace_id")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 ELSE 2 END AS attempts, CASE doc_id % 4 WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'overall_score_mismatch' END AS code, CASE WHEN doc_id % 4 < 2 THEN (quality + 1 - toxic) / 2.0::DOUBLE END AS score FROM labels JOIN documents USING (doc_id)""")
def judge_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two responses that holds; only malformed ones are asked again."""
    rows = _judged(spark, sf_dir)
    n = F.col("doc_id")
    criterion = lambda c, k: F.concat(F.lit(f'{{"criterion":"{c}","passed":'), (F.col(k) >= 0.5).cast("string"), F.lit(',"reason":"r","score":'), F.col(k).cast("string"), F.lit("}"))
    answer = lambda overall: F.concat(F.lit('{"schema_version":1,"confidence":0.9,"overall_score":'), overall.cast("string"), F.lit(',"overall_passed":'), ((F.col("s1") >= 0.5) & (F.col("s2") >= 0.5)).cast("string"), F.lit(',"criteria":['), criterion("good", "s1"), F.lit(","), criterion("clean", "s2"), F.lit("]}"))
    good, wrong, broken = answer((F.col("s1") + F.col("s2")) / 2), answer(F.lit(0.123)), F.lit("{broken")
    listed = F.when(n % 4 == 0, F.array(good, broken)).when(n % 4 == 1, F.array(broken, good)).when(n % 4 == 2, F.array(broken, broken)).otherwise(F.array(broken, wrong))
    judged = rows.select("doc_id", judging.judge_outputs(listed, F.array(F.lit("good"), F.lit("clean"))).alias("j"))
    return judged.select("doc_id", "j.attempts", "j.code", "j.score")


@query("""SELECT cache_key, CASE CAST(cache_key AS INT) % 5 WHEN 0 THEN 'no answer' WHEN 1 THEN 'identity isn''t canonical' WHEN 2 THEN 'another identity' ELSE 'key isn''t the identity''s hash' END AS fault FROM (SELECT CAST(doc_id AS VARCHAR) AS cache_key FROM labels WHERE doc_id % 5 < 4)""")
def cache_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached judgments that aren't what was asked, by fault."""
    n = F.col("doc_id")
    identity = F.concat(F.lit('{"n":'), n, F.lit("}"))
    key = n.cast("string")
    rows = table(spark, sf_dir, "labels").select(n, F.when(n % 5 == 4, judging.cache_key(identity)).otherwise(key).alias("cache_key"), identity.alias("identity_json"), F.when(n % 5 != 0, F.lit("{}")).alias("raw_response"))
    held = rows.withColumn("identity_json", F.when(n % 5 == 1, F.concat(F.lit(" "), identity)).when(n % 5 == 2, F.lit('{"n":-1}')).otherwise(identity))
    return judging.cache_faults(rows, held)


@query("""SELECT CAST(user_id AS VARCHAR) AS cache_key, arg_min(event_type, event_id) AS raw_response FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup' AND value > 150) = 0""")
def upsert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a cache takes: the first writer of each key that it doesn't hold."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_type").alias("raw_response"), F.col("event_id").alias("written_at"), "value")
    held = rows.filter("raw_response = 'signup' and value > 150").select("cache_key").distinct()
    return judging.new_entries(rows, held).select("cache_key", "raw_response")


@query(f"""{V} SELECT eval_id FROM cases WHERE evaluation_mode = 'rubric' AND (conv_id % 4 IN (0, 1) OR conv_id % 5 = 0)""")
def rubric_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubrics with blank criteria, with criteria that repeat after stripping, or with none."""
    n = F.col("conv_id")
    rubric = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 4 == 0, F.array(F.lit("a"), F.lit("　a\n"))).when(n % 4 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit("A")))
    return judging.rubric_faults(cases(spark, sf_dir).withColumn("rubric", rubric)).select("eval_id")


@query("""SELECT doc_id, contains(lower(text), 'the ') AS held, regexp_matches(text, '[A-Z][a-z]+ing') AS matched, length(text) AS n FROM documents""")
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring and pattern tests over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", scoring.contains(F.col("text"), "THE ", False).alias("held"), scoring.regex(F.col("text"), "[A-Z][a-z]+ing").alias("matched"), F.length("text").cast("long").alias("n"))
