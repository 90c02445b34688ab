"""The catalog's log: changes of several tables, writers that die, writers that race, folded rows."""

import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from assayer.plans import log as log_module
from assayer.plans.log import Change, Log
from assayer.plans.store import Catalog, StoreError
from assayer.schemas import schema

NOW = datetime(2026, 1, 2, 3, 4, 5, 678901, tzinfo=UTC)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def case(dataset, n):
    return (f"{dataset}-e{n}", dataset, f"t{n}", "reference", "medium", "draft", "chat", "p", "{}", None, None, "r", "r")


def built(spark, dataset, n=3):
    cases = spark.createDataFrame([case(dataset, i) for i in range(n)], schema("cases"))
    fields = schema("slice_provenance")
    held = [{"eval_id": f"{dataset}-e{i}", "dataset_id": dataset, "trace_id": f"t{i}"} for i in range(n)]
    provenance = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in held], fields)
    build = spark.createDataFrame([(dataset, "run", n, "m", "c", "s", NOW)], schema("slice_builds"))
    return cases, provenance, build


def seal(spark, catalog, name):
    from assayer.functions.ids import dataset_id

    made = dataset_id(name, "1")
    with catalog.change() as change:
        catalog.create_dataset(name, "1", within=change)
        catalog.seal(made, *built(spark, made), change)
    return made


def counts(catalog):
    return {t: catalog.read(t).count() for t in ("datasets", "cases", "slice_provenance", "slice_builds")}


def test_several_tables_appear_together(spark, root):
    catalog = Catalog(spark, root)
    made = seal(spark, catalog, "a")
    assert counts(catalog) == {"datasets": 1, "cases": 3, "slice_provenance": 3, "slice_builds": 1} and catalog.view().version == 1
    with pytest.raises(StoreError, match="sealed"):
        catalog.add_cases(made, built(spark, made)[0])
    with pytest.raises(StoreError, match="exists"):
        seal(spark, catalog, "a")
    assert catalog.view().version == 1


class Killed(BaseException):
    """Ends a writer where it stands, past every handler of errors."""


#: The steps of a change: folders written, record staged, record put.
STEPS = ["write 1", "write 2", "write 3", "stage", "put"]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_killed_between_two_steps(spark, root, monkeypatch, step):
    """Readers see nothing of a writer that died before its record was put, and all of one that died after."""
    Catalog(spark, root)
    reader, writer = Catalog(spark, root), Catalog(spark, root)
    seal(spark, reader, "before")
    was = counts(reader)
    monkeypatch.setattr(Change, "abandon", lambda self: None)  # a process that is gone cleans nothing up
    write, staged, put, done = Log.write, Log._write, Log._put, []

    def dying_write(self, table, rows):
        folder = write(self, table, rows)
        done.append(table)
        if step == f"write {len(done)}":
            raise Killed
        return folder

    def dying_stage(self, path, text, overwrite=False):
        staged(self, path, text, overwrite)
        if step == "stage":
            raise Killed

    def dying_put(self, target, text):
        result = put(self, target, text)
        if step == "put":
            raise Killed
        return result

    for name, f in (("write", dying_write), ("_write", dying_stage), ("_put", dying_put)):
        monkeypatch.setattr(Log, name, f)
    with pytest.raises(Killed):
        seal(spark, writer, "killed")
    monkeypatch.undo()
    fresh = Catalog(spark, root)
    if step == "put":
        assert counts(fresh) == counts(reader) == {k: 2 * n for k, n in was.items()}
    else:
        assert counts(fresh) == counts(reader) == was
        seal(spark, fresh, "killed")  # nothing stands in the way of another try
        assert counts(reader) == {k: 2 * n for k, n in was.items()}


def race(n, attempt):
    """attempt(i) in n threads at once; what each returned or raised."""
    out, gate = [None] * n, threading.Barrier(n)

    def run(i):
        gate.wait()
        try:
            out[i] = attempt(i)
        except StoreError as error:
            out[i] = error

    threads = [threading.Thread(target=run, args=(i,)) for i in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


@pytest.mark.parametrize("links", [True, False])
def test_a_record_is_put_once(spark, root, links):
    """Both ways of putting a file fail where one is."""
    log = Log(spark, root, links)
    view = log.view()
    empty = {"folders": {}, "names": {}, "buckets": {}}
    assert log.put(view, empty | {"rows": {"run_events": [{"run_id": "a"}]}})
    assert not log.put(view, empty | {"rows": {"run_events": [{"run_id": "b"}]}})
    assert [r["run_id"] for r in log.view().rows["run_events"]] == ["a"]
    left = [s.getPath().getName() for s in log.fs.listStatus(log._path("_log"))]
    assert left == ["00000000000000000001.json"]


def test_eight_writers_of_the_same_keys(spark, root):
    """One writer a key, whoever came first; each knows what it stored and keeps its own answers."""
    Catalog(spark, root)
    own = {}

    def attempt(i):
        catalog = Catalog(spark, root)
        rows = [(f"k{(i + j) % 12}", "{}", f"answer of {i}", NOW) for j in range(8)]
        own[i] = rows
        with catalog.change() as change:
            taken = change.first("judge_cache", "cache_key", spark.createDataFrame(rows, schema("judge_cache")))
        return {r.cache_key for r in taken.rows().collect()}

    taken = race(8, attempt)
    stored = {r.cache_key: r.raw_response for r in Catalog(spark, root).read("judge_cache").collect()}
    assert Catalog(spark, root).read("judge_cache").count() == len(stored) == 12
    for i, keys in enumerate(taken):
        assert keys == {k for k, answer in stored.items() if answer == f"answer of {i}"}
        assert len(own[i]) == 8
    assert sum(map(len, taken)) == 12


def test_keys_of_other_buckets_are_not_compared(spark, root, monkeypatch):
    catalog, other = Catalog(spark, root), Catalog(spark, root)
    rows = lambda *keys: spark.createDataFrame([(k, "{}", "r", NOW) for k in keys], schema("judge_cache"))
    bucket = dict(rows(*[f"k{i}" for i in range(40)]).select("cache_key", F.pmod(F.xxhash64("cache_key"), F.lit(log_module.BUCKETS)).alias("b")).collect())
    near = next(k for k in bucket if k != "k0" and bucket[k] != bucket["k0"])
    change = Change(catalog.log)
    held = change.first("judge_cache", "cache_key", rows("k0"))
    held.settle(catalog.view())
    with other.change() as meanwhile:
        meanwhile.first("judge_cache", "cache_key", rows(near))
    monkeypatch.setattr(type(held), "rows", lambda self: pytest.fail("compared again"))
    held.settle(catalog.view())
    monkeypatch.undo()
    with other.change() as meanwhile:
        meanwhile.first("judge_cache", "cache_key", rows("k0"))
    assert change.commit() == catalog.view().version  # nothing is left to store
    assert catalog.view().version == 2 and catalog.read("judge_cache").count() == 2


def test_two_writers_cannot_both_start_a_run(spark, root):
    catalog = Catalog(spark, root)
    catalog.move("run_events", "run_id", "r", "pending", experiment_id="x")
    got = race(4, lambda i: Catalog(spark, root).move("run_events", "run_id", "r", "running", experiment_id="x"))
    assert sum(isinstance(g, StoreError) for g in got) == 3
    events = sorted((r.sequence, r.status) for r in catalog.read("run_events").collect())
    assert events == [(1, "pending"), (2, "running")]


def test_two_writers_of_one_label(spark, root):
    """Both see two slices without a name; only one gets the label."""
    catalog = Catalog(spark, root)
    with catalog.change() as change:
        change.put("cluster_labels", [{"clustering_run_id": "c", "cluster_number": n, "version": 0, "updated_at": NOW} for n in range(4)])
    got = race(4, lambda i: Catalog(spark, root).rename_slice("c", i, "Refunds"))
    assert sum(isinstance(g, StoreError) for g in got) == 3
    assert [r.label for r in catalog.labels("c").filter("label is not null").collect()] == ["Refunds"]


def test_ten_thousand_events_in_two_files(spark, root):
    """Reads take the snapshot's one file and the records behind, whatever the number of events."""
    catalog = Catalog(spark, root)
    for k in range(100):
        with catalog.change() as change:
            change.put("run_events", [{"run_id": f"r{k}-{i}", "experiment_id": "x", "sequence": 1, "status": "pending", "at": NOW} for i in range(100)])
    view = catalog.view()
    rows = catalog.read("run_events")
    assert rows.count() == 10_000 and rows.filter(F.col("at") == F.lit(NOW)).count() == 10_000
    assert len(rows.inputFiles()) == 1 and view.version - view.snapshot <= log_module.FOLD
    fresh = Catalog(spark, root)
    assert fresh.view() == view and fresh.read("run_events").count() == 10_000
    assert fresh.last_event("run_events", "run_id", "r0-0")["status"] == "pending"  # from the snapshot
    assert fresh.last_event("run_events", "run_id", "r99-99")["sequence"] == 1  # from the records
    fresh.move("run_events", "run_id", "r0-0", "running", experiment_id="x")
    with pytest.raises(StoreError, match="can't go from running"):
        catalog.move("run_events", "run_id", "r0-0", "pending", experiment_id="x")


def test_many_folders_become_one(spark, root, monkeypatch):
    monkeypatch.setattr(log_module, "FOLDERS", 4)
    monkeypatch.setattr(log_module, "FOLD", 6)
    catalog = Catalog(spark, root)
    old = catalog.view()
    for i in range(15):
        catalog.commit("outputs", spark.createDataFrame([("r", "x", "baseline", f"e{i}", "o", 1.0, None)], schema("outputs")), f"n{i}")
        old = catalog.view() if i == 5 else old
    assert sorted(r.eval_id for r in catalog.read("outputs").collect()) == sorted(f"e{i}" for i in range(15))
    assert len(catalog.view().folders["outputs"]) < 12
    assert catalog.read("outputs", old).count() == 6  # an older view still holds
    with pytest.raises(StoreError, match="already"):
        catalog.commit("outputs", catalog.read("outputs"), "n0")


def test_another_format_is_refused(spark, root, tmp_path):
    spark.createDataFrame([("1",)], "value string").coalesce(1).write.text(f"{root}/_format")
    with pytest.raises(StoreError, match="format"):
        Catalog(spark, root)
