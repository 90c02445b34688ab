"""Clustering runs and datasets built from their slices, end to end over a catalog."""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.ids import eval_id, sha256
from assayer.functions.json_text import canonical_dumps
from assayer.functions.shared import forget, written
from assayer.operators import clustering, sampling
from assayer.operators.clustering import ClusteringError
from assayer.plans.log import View
from assayer.plans.store import Catalog, StoreError
from assayer.schemas import schema
from assayer.sources.traces import payload


def _hashed(traces: DataFrame) -> DataFrame:
    text = clustering.document_text(F.col("prompt"), F.col("context_json"))
    return traces.withColumn("document", text).withColumn("document_hash", sha256(F.col("document"))).withColumn("source_trace_hash", sha256(payload(traces)))


def cluster_traces(catalog: Catalog, name: str, k: int, components: int | None = None, restarts: int = 20) -> str:
    """Clusters all traces into k slices and stores the run, after the source is seen unchanged.

    Slices are those of the cheapest of so many starts; they are found in the same way at every size.
    """
    spark, start = catalog.spark, catalog.view()
    traces = _hashed(catalog.read("traces", start))
    count = traces.count()
    if not 1 <= k <= count:
        raise ClusteringError(f"{k} clusters of {count} traces")
    manifest = clustering.source_manifest(traces)
    weights = written(clustering.tfidf(traces, "trace_id", "document"), "slice-weights")
    if weights.isEmpty():
        raise ClusteringError("the traces have no terms")
    vectors, terms = clustering.sparse_vectors(weights, traces.select(F.col("trace_id").alias("id")))
    if k > clustering.distinct(vectors):
        raise ClusteringError(f"{k} clusters need as many distinct vectors")
    if components is not None:
        vectors, _ = clustering.decomposed(vectors, terms, components)
    made, cost = clustering.kmeans(vectors, k, restarts, width=components or terms)
    made = made.select(F.col("id").alias("trace_id"), "cluster")
    config = {"algorithm": "tfidf-kmeans", "clusters": k, "components": components, "restarts": restarts, "seed": 42, "spark": spark.version, "numpy": np.__version__}
    run = f"cluster_run_{uuid.uuid4().hex}"
    indexed = clustering.document_index(traces.select("trace_id", "document_hash", "source_trace_hash"))
    rows = written(clustering.canonical_numbers(made).join(indexed, "trace_id").withColumn("clustering_run_id", F.lit(run)), "slice-rows")
    if rows.count() != count:
        raise ClusteringError("traces were added meanwhile")
    now = datetime.now(UTC)
    digest = hashlib.sha256(canonical_dumps(config).encode()).hexdigest()

    def unchanged(view: View) -> None:
        if view.changed.get("traces") != start.changed.get("traces") and clustering.source_manifest(_hashed(catalog.read("traces", view))) != manifest:
            raise ClusteringError("traces were added meanwhile")

    def unnamed(view: View) -> None:
        if catalog.read("clustering_runs", view).filter(F.col("name") == name.strip()).head():
            raise ClusteringError(f"a run named {name.strip()!r} exists")

    with catalog.change() as change:
        change.require(unchanged, "traces")
        change.require(unnamed, "clustering_runs")
        change.add("cluster_assignments", rows, run)
        change.put("cluster_labels", [{"clustering_run_id": run, "cluster_number": n, "label": None, "label_key": None, "version": 0, "updated_at": now} for n in range(k)], run)
        head = {"clustering_run_id": run, "name": name.strip(), "configuration_hash": digest, "source_manifest_hash": manifest, "trace_count": count, "cluster_count": k, "inertia": float(cost), "created_at": now}
        change.put("clustering_runs", [head], run)
    for used in (weights, vectors, made, rows):
        forget(used)
    return run


def assigned(catalog: Catalog, run: str) -> DataFrame:
    """The assignments of a run with their traces, in the order of document_index."""
    held = catalog.read("cluster_assignments").filter(F.col("clustering_run_id") == run)
    return held.join(catalog.read("traces"), "trace_id").orderBy("document_index")


def changed_sources(catalog: Catalog, run: str) -> DataFrame:
    """Assignments whose trace is gone or no longer has the hashes that the run saw."""
    held = catalog.read("cluster_assignments").filter(F.col("clustering_run_id") == run)
    now = _hashed(catalog.read("traces")).select("trace_id", F.col("document_hash").alias("d"), F.col("source_trace_hash").alias("s"))
    return held.join(now, "trace_id", "left").filter(~(F.col("document_hash").eqNullSafe(F.col("d")) & F.col("source_trace_hash").eqNullSafe(F.col("s"))))


def snapshot_faults(catalog: Catalog, run: str) -> DataFrame:
    """(fault, n) of a stored run: what its assignments, indexes, slices and sources should be and aren't.

    assignments: how many more or fewer than the run's traces; changed: sources that changed or are
    gone; foreign_times: traces without a time; gaps: indexes that repeat, are missing or don't follow
    the order of ids; slices: slices that no assignment has, or that the run doesn't know.
    """
    spark = catalog.spark
    head = catalog.read("clustering_runs").filter(F.col("clustering_run_id") == run).head()
    if head is None:
        raise StoreError(f"{run} doesn't exist")
    held = catalog.read("cluster_assignments").filter(F.col("clustering_run_id") == run)
    right = clustering.document_index(held.select("trace_id")).select("trace_id", F.col("document_index").alias("right"))
    counts = held.join(right, "trace_id").agg(
        F.abs(F.count("*") - F.lit(head.trace_count)).alias("assignments"), F.count_if(~F.col("document_index").eqNullSafe(F.col("right"))).alias("gaps"),
        F.abs(F.countDistinct(F.when(F.col("cluster_number").between(0, head.cluster_count - 1), F.col("cluster_number"))) - F.lit(head.cluster_count)).alias("absent"), F.count_if(~F.col("cluster_number").between(0, head.cluster_count - 1)).alias("beyond"),
    ).head()
    rows = [("assignments", counts.assignments), ("changed", changed_sources(catalog, run).count()), ("foreign_times", assigned(catalog, run).filter("timestamp is null").count()), ("gaps", counts.gaps), ("slices", counts.absent + counts.beyond)]
    return spark.createDataFrame(rows, "fault string, n long")


def check_snapshot(catalog: Catalog, run: str) -> None:
    """Raises where a stored run doesn't hold together."""
    if bad := snapshot_faults(catalog, run).filter("n > 0").collect():
        raise StoreError(f"{run}: " + ", ".join(f"{r.n} {r.fault}" for r in bad))


def history(catalog: Catalog) -> DataFrame:
    """Signals of all earlier cases and results."""
    from assayer.plans.constraints import current_status

    runs = catalog.read("runs").join(current_status(catalog.read("run_events"), "run_id"), "run_id")
    experiments = current_status(catalog.read("experiment_events"), "experiment_id")
    return sampling.history_signals(catalog.read("cases"), catalog.read("case_results"), runs, experiments)


def build_from_slices(catalog: Catalog, run: str, name: str, version: str, size: int, overrides: DataFrame) -> str:
    """A sealed dataset of size cases, balanced over the run's slices; nothing is stored on an error."""
    start = catalog.view()
    head = catalog.read("clustering_runs", start).filter(F.col("clustering_run_id") == run).head()
    if head is None:
        raise StoreError(f"{run} doesn't exist")
    if bad := changed_sources(catalog, run).limit(1).collect():
        raise StoreError(f"trace {bad[0].trace_id} changed after {run}")
    check_snapshot(catalog, run)
    traces = catalog.read("traces", start)
    assigned = catalog.read("cluster_assignments", start).filter(F.col("clustering_run_id") == run).join(traces, "trace_id")
    candidates = sampling.eligible(assigned, history(catalog), head.configuration_hash, head.source_manifest_hash).cache()
    sample = sampling.select_sample(candidates, size).cache()
    if unused := [r[0] for r in sampling.unused_overrides(overrides, sample).limit(5).collect()]:
        raise StoreError("overrides of traces that weren't selected: " + ", ".join(unused))
    labels = catalog.labels(run, start)
    from assayer.functions.ids import dataset_id

    made = dataset_id(name, version)
    cases = sampling.build_cases(sample, overrides, made).join(sample.select(F.col("trace_id").alias("source_trace_id"), "task_type", "prompt", "context_json"), "source_trace_id")
    provenance = sample.join(labels.select("cluster_number", "label", "label_key"), "cluster_number").select(
        eval_id(F.lit(made), F.col("trace_id")).alias("eval_id"), F.lit(made).alias("dataset_id"), "trace_id", "cluster_number", F.concat(F.lit("cluster-"), "cluster_number").alias("selector"),
        F.col("label").alias("label_snapshot"), F.col("label_key").alias("label_key_snapshot"), "preference_tier", "critical_priority_signal", "prior_failure_signal", "selection_key", "allocation_key", "selection_rank", "document_hash", "source_trace_hash",
    )
    manifest = sampling.build_manifest(candidates, size, labels).orderBy("cluster_number").collect()  # a row for each slice
    digest = hashlib.sha256(canonical_dumps([r.asDict() for r in manifest]).encode()).hexdigest()
    build = catalog.spark.createDataFrame([(made, run, size, digest, head.configuration_hash, head.source_manifest_hash, datetime.now(UTC))], schema("slice_builds"))

    def as_read(view: View) -> None:
        if any(view.changed.get(t) != start.changed.get(t) for t in ("traces", "cluster_labels")):
            raise StoreError("traces or labels changed meanwhile")

    with catalog.change() as change:
        change.require(as_read, "traces", "cluster_labels")
        catalog.create_dataset(name, version, within=change)
        catalog.seal(made, cases, provenance, build, change)
    for used in (candidates, sample):
        used.unpersist()
    return made
