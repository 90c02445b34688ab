"""The command line: ingest, traces, slices, datasets, experiments.

Exit codes: 0 done or PASS, 1 FAIL or a refused write, 2 a faulty request (nothing stored), 3 a
failure after an experiment was accepted.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayer.operators.clustering import ClusteringError
from assayer.operators.comparing import ComparisonError
from assayer.operators.sampling import SamplingError
from assayer.operators.scoring import ScorerError
from assayer.plans import export, slicing
from assayer.plans.config import ConfigError, load_config
from assayer.plans.constraints import ConstraintError
from assayer.plans.experiment import Experiment, OperationalError, load_detail, load_report
from assayer.plans.store import Catalog, StoreError
from assayer.sources.fixtures import FixtureError, read_overrides
from assayer.sources.traces import find_trace, ingest, IngestError, newest_first, utc_text

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assayer")
    top.add_argument("--store", default="assayer-store")
    top.add_argument("--master", default=None)
    commands = top.add_subparsers(dest="command", required=True)

    def command(*names: str, **options: dict) -> None:
        at = commands
        for name in names[:-1]:
            group = at.choices.get(name) or at.add_parser(name)
            at = next((a for a in group._actions if isinstance(a, argparse._SubParsersAction)), None) or group.add_subparsers(dest=f"{name}_command", required=True)
        made = at.add_parser(names[-1])
        made.set_defaults(run="_".join(names))
        for key, value in options.items():
            made.add_argument(key.replace("__", "--").replace("_", "-") if key.startswith("__") else key, **value)

    flag = {"action": "store_true"}
    command("version")
    command("ingest", path={})
    command("traces", "list", __limit={"type": int, "default": 20})
    command("traces", "cluster", name={}, __clusters={"type": int, "required": True}, __components={"type": int})
    command("slices", "list", run_id={})
    command("slices", "rename", run_id={}, number={"type": int}, label={})
    command("dataset", "create", name={}, version={})
    command("dataset", "build", name={}, version={}, __run={"required": True, "dest": "run_of"}, __size={"type": int, "required": True}, __cases={})
    command("dataset", "list")
    command("dataset", "add-trace", reference={}, trace_id={}, __mode={"default": "reference"}, __scorers={}, __rubric={"action": "append"}, __priority={"default": "medium"})
    command("dataset", "show", reference={})
    command("dataset", "export", reference={}, path={}, __overwrite=flag)
    command("experiment", "run", config={}, __json=flag)
    command("experiment", "export", experiment_id={}, path={}, __overwrite=flag)
    return top


def _add_trace(catalog: Catalog, args: argparse.Namespace) -> None:
    from assayer.functions.ids import eval_id
    from assayer.operators.scoring import prepare

    dataset = catalog.find_dataset(args.reference)
    trace = find_trace(catalog.read("traces"), args.trace_id)
    if trace.isEmpty():
        raise StoreError(f"trace {args.trace_id} doesn't exist")
    scorers = json.loads(args.scorers) if args.scorers else []
    for s in scorers:
        prepare(s["name"], s.get("config", {}))
    listed = F.array(*[F.struct(F.lit(s["name"]).alias("name"), F.lit(json.dumps(s.get("config", {}), sort_keys=True)).alias("config")) for s in scorers]) if scorers else F.lit(None)
    answer = F.col("response") if args.mode == "reference" else F.lit(None).cast("string")
    row = trace.select(
        eval_id(F.lit(dataset), F.col("trace_id")).alias("eval_id"), F.lit(dataset).alias("dataset_id"), F.col("trace_id").alias("source_trace_id"), F.lit(args.mode).alias("evaluation_mode"), F.lit(args.priority).alias("priority"), F.lit("draft").alias("review_status"),
        "task_type", "prompt", "context_json", listed.cast("array<struct<name:string,config:string>>").alias("scorers"), F.array(*map(F.lit, args.rubric or [])).cast("array<string>").alias("rubric"), answer.alias("reference_answer"), answer.alias("source_response"),
    )
    catalog.add_cases(dataset, row)


def execute(spark: SparkSession, args: argparse.Namespace) -> int:
    catalog, run = Catalog(spark, args.store), args.run
    table = lambda df: print("\n".join("\t".join("" if v is None else str(v) for v in r) for r in df.collect()))  # noqa: E731  short listings
    if run == "ingest":
        rows, bad, counters = ingest(spark, args.path, catalog.read("traces"))
        for r in bad.orderBy("file", "line").toLocalIterator():
            print(r.message, file=sys.stderr)
        if counters.stored:
            with catalog.change() as change:
                change.first("traces", "trace_id", rows)
        print(json.dumps(counters.__dict__))
    elif run == "traces_list":
        table(newest_first(catalog.read("traces")).limit(args.limit).select("trace_id", utc_text(F.col("timestamp")), "task_type"))
    elif run == "traces_cluster":
        print(slicing.cluster_traces(catalog, args.name, args.clusters, args.components))
    elif run == "slices_list":
        table(catalog.slices(args.run_id))
    elif run == "slices_rename":
        catalog.rename_slice(args.run_id, args.number, args.label)
    elif run == "dataset_create":
        print(catalog.create_dataset(args.name, args.version))
    elif run == "dataset_build":
        print(slicing.build_from_slices(catalog, args.run_of, args.name, args.version, args.size, read_overrides(spark, args.cases)))
    elif run == "dataset_list":
        table(catalog.datasets())
    elif run == "dataset_add-trace":
        _add_trace(catalog, args)
    elif run == "dataset_show":
        for line in export.dataset_lines(catalog, catalog.find_dataset(args.reference)):
            print(line)
    elif run == "dataset_export":
        export.export_dataset(catalog, catalog.find_dataset(args.reference), args.path, args.overwrite)
    elif run == "experiment_run":
        report = load_report(catalog, Experiment(catalog, load_config(args.config)).run())
        print(json.dumps(export._plain(report), sort_keys=True) if args.json else export.report_text(report))
        return 0 if report["verdict"] == "PASS" else 1
    elif run == "experiment_export":
        report = load_report(catalog, args.experiment_id)
        report["cases"] = [r.asDict(True) for r in load_detail(catalog, args.experiment_id).orderBy("eval_id").toLocalIterator()]
        export.export_report(report, args.path, args.overwrite)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.run == "version":
        print(VERSION)
        return 0
    if spark is None:
        builder = SparkSession.builder.appName("assayer").config("spark.sql.session.timeZone", "UTC")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    try:
        return execute(spark, args)
    except (ConfigError, FixtureError, ClusteringError, ComparisonError, SamplingError, ScorerError) as error:
        print(error, file=sys.stderr)
        return 2
    except OperationalError as error:
        print(error, file=sys.stderr)
        return 3
    except (StoreError, ConstraintError, IngestError) as error:
        print(error, file=sys.stderr)
        return 2 if args.run in ("dataset_build", "experiment_run", "experiment_export") else 1


if __name__ == "__main__":
    sys.exit(main())
