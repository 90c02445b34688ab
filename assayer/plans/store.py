"""A catalog of append-only Parquet tables whose changes, of several tables at once, are atomic.

What a change adds appears with one record of the log (see log.py), which is put only if no other
writer was there before; checks are made against the version that it follows. There are no updates:
state changes are event rows, renamed labels are new versions, and sealed datasets take no more cases.
"""

from __future__ import annotations

from contextlib import contextmanager
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import label_key_of
from assayer.plans import constraints
from assayer.plans.log import Change, Log, View, text_of
from assayer.schemas import DDL

FORMAT = "2"


class StoreError(ValueError):
    """A write that the catalog refuses."""


class Catalog:
    """Tables below one path, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("_format")
        if self._fs().exists(path):  # a file; a folder of one in older catalogs
            held = self.spark.read.text(path.toString()).head()[0] if self._fs().getFileStatus(path).isDirectory() else text_of(spark, self._fs(), path)
            if held != FORMAT:
                raise StoreError(f"{root} has format {held}; this version reads {FORMAT}")
        self.log = Log(spark, self.root)
        if not self._fs().exists(path):
            self.log.put_file("_format", FORMAT)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def view(self) -> View:
        """The newest version, for several reads that belong together."""
        return self.log.view()

    def read(self, table: str, view: View | None = None) -> DataFrame:
        """All rows of a table, as of a view or now."""
        return self.log.read(table, view or self.log.view())

    @contextmanager
    def change(self, within: Change | None = None) -> Iterator[Change]:
        """A change that is committed at the end of the block, or the one that it is part of."""
        if within is not None:
            yield within
            return
        with Change(self.log) as made:
            yield made

    def commit(self, table: str, rows: DataFrame, name: str | None = None) -> None:
        """Adds rows to one table; a name that the table has had is an error."""
        with self.change() as made:
            if name is not None:
                self._new(made, table, name, f"{table} has {name} already")
            made.add(table, rows, name)

    def _new(self, change: Change, table: str, name: str, message: str) -> None:
        def check(view: View) -> None:
            if view.has(table, name):
                raise StoreError(message)

        check(change.start)
        change.require(check, table)

    def has(self, table: str, name: str) -> bool:
        return self.log.view().has(table, name)

    # Datasets

    def create_dataset(self, name: str, version: str, description: str = "", within: Change | None = None) -> str:
        from assayer.functions.ids import dataset_id

        if not name.strip() or not version.strip() or ":" in name + version:
            raise StoreError("name and version must be filled and have no colon")
        made = dataset_id(name, version)
        with self.change(within) as change:
            self._new(change, "datasets", made, f"{name}:{version} exists already")
            change.put("datasets", [{"dataset_id": made, "name": name.strip(), "version": version.strip(), "description": description, "created_at": datetime.now(UTC)}], made)
        return made

    def find_dataset(self, reference: str) -> str:
        """The id that name:version stands for."""
        from assayer.functions.ids import dataset_id

        parts = [p.strip() for p in reference.split(":")]
        if len(parts) != 2 or not all(parts):
            raise StoreError(f"{reference!r} must be name:version")
        made = dataset_id(*parts)
        if not self.has("datasets", made):
            raise StoreError(f"{reference} doesn't exist")
        return made

    def add_cases(self, dataset: str, cases: DataFrame, within: Change | None = None) -> None:
        """Appends cases of a dataset that isn't sealed; every case has the shape of its mode and a trace of its own."""

        def open_still(view: View) -> None:
            if view.has("slice_builds", dataset):
                raise StoreError(f"{dataset} is sealed")

        open_still(self.log.view())
        with self.change(within) as change:
            stored = change.add("cases", cases)  # made once: no record names them before they are checked
            constraints.check(stored, constraints.case_shape(), "cases that don't fit their mode")

            def traces_once(view: View) -> None:
                held = self.read("cases", view).filter(F.col("dataset_id") == dataset).select("source_trace_id")
                constraints.check_empty(constraints.repeated(held.unionByName(stored.select("source_trace_id")), "source_trace_id"), "traces used twice")

            change.require(open_still, "slice_builds")
            change.require(traces_once, "cases")

    def seal(self, dataset: str, cases: DataFrame, provenance: DataFrame, build: DataFrame, within: Change | None = None) -> None:
        """Writes a sliced dataset whole: its cases, their provenance and its seal appear together."""
        constraints.check_empty(constraints.incomplete_builds(build, cases, provenance), "builds that aren't complete")
        constraints.check_empty(constraints.orphans(provenance, cases, "eval_id"), "provenance without a case")
        with self.change(within) as change:
            self.add_cases(dataset, cases, change)
            change.add("slice_provenance", provenance)
            change.add("slice_builds", build, dataset)

    def datasets(self) -> DataFrame:
        """Datasets by name and version with their number of cases, empty ones too."""
        rows = self.read("datasets").join(self.read("cases").select("dataset_id", "eval_id"), "dataset_id", "left")
        return rows.groupBy("dataset_id", "name", "version").agg(F.count("eval_id").alias("case_count")).orderBy("name", "version")

    # Slices

    def labels(self, run: str, view: View | None = None) -> DataFrame:
        """The last version of each slice's label."""
        rows = self.read("cluster_labels", view).filter(F.col("clustering_run_id") == run)
        last = F.row_number().over(Window.partitionBy("cluster_number").orderBy(F.desc("version")))
        return rows.withColumn("_last", last).filter("_last = 1").drop("_last")

    def rename_slice(self, run: str, number: int, label: str) -> None:
        """A new version of one slice's label; the same label is no change, another slice's is an error."""
        if not label.strip():
            raise StoreError("a label must not be blank")
        key = label_key_of(label)
        with self.change() as change:

            def versioned(view: View) -> None:
                held = {r.cluster_number: r for r in self.labels(run, view).collect()}  # as many as slices
                if number not in held:
                    raise StoreError(f"cluster-{number} doesn't exist")
                if any(r.label_key == key for n, r in held.items() if n != number):
                    raise StoreError(f"another slice is labeled {label.strip()!r}")
                change.withdraw("cluster_labels")
                if held[number].label != label.strip():
                    change.put("cluster_labels", [{"clustering_run_id": run, "cluster_number": number, "label": label.strip(), "label_key": key, "version": held[number].version + 1, "updated_at": datetime.now(UTC)}])

            change.require(versioned, "cluster_labels")

    def slices(self, run: str) -> DataFrame:
        """Slices with labels and sizes."""
        members = self.read("cluster_assignments").filter(F.col("clustering_run_id") == run)
        return self.labels(run).join(members.select("cluster_number", "trace_id"), "cluster_number", "left").groupBy("cluster_number", "label").agg(F.count("trace_id").alias("trace_count")).orderBy("cluster_number")

    # States

    def move(self, table: str, owner: str, name: str, status: str, within: Change | None = None, **columns: str | None) -> None:
        """Appends a status event, which must follow from the last one of the version that it follows."""
        row = {owner: name, "status": status, "at": datetime.now(UTC), **columns}
        with self.change(within) as change:

            def follows(view: View) -> None:
                last = self.last_event(table, owner, name, view)
                if table == "run_events" and last and status not in constraints.NEXT[last["status"]]:
                    raise StoreError(f"{name} can't go from {last['status']} to {status}")
                row["sequence"] = (last["sequence"] if last else 0) + 1
                change.withdraw(table, owner, name)
                change.put(table, [row])

            change.require(follows, table)

    def last_event(self, table: str, owner: str, name: str, view: View | None = None) -> dict[str, Any] | None:
        """An owner's last event: among the rows behind the snapshot, or else in the snapshot's file."""
        view = view or self.log.view()
        tail = [r for r in view.rows.get(table, ()) if r[owner] == name]
        if tail:
            return max(tail, key=lambda r: r["sequence"])
        if not view.folders.get(table):
            return None
        found = self.log.read(table, view).filter(F.col(owner) == name).orderBy(F.desc("sequence")).head()
        return found.asDict() if found else None

    def integrity(self) -> dict[str, int]:
        """Rows without the row that they refer to, by relation."""
        relations = [
            ("cluster_assignments", "clustering_run_id", "clustering_runs", "clustering_run_id"), ("cluster_assignments", "trace_id", "traces", "trace_id"), ("cases", "dataset_id", "datasets", "dataset_id"),
            ("cases", "source_trace_id", "traces", "trace_id"), ("slice_provenance", "eval_id", "cases", "eval_id"), ("experiments", "dataset_id", "datasets", "dataset_id"), ("runs", "experiment_id", "experiments", "experiment_id"),
            ("case_results", "run_id", "runs", "run_id"), ("case_results", "eval_id", "cases", "eval_id"), ("case_comparisons", "experiment_id", "experiments", "experiment_id"), ("gate_violations", "experiment_id", "experiments", "experiment_id"),
        ]
        return {f"{c}.{k}": constraints.orphans(self.read(c), self.read(p), k, pk).count() for c, k, p, pk in relations}


TABLES = tuple(DDL)
