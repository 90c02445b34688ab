import json

import pytest
from pyspark.sql import functions as F

from assayer.plans.store import Catalog
from assayer.sources.traces import IngestError, ingest, newest_first, parse_trace, payload, utc_text
from assayer.streaming.ingest import stream_traces, windowed_counts


def record(**changes):
    value = {"trace_id": "t1", "timestamp": "2026-01-02T10:00:00.500-04:00", "task_type": "qa", "prompt": " p "} | changes
    return json.dumps({k: v for k, v in value.items() if v is not ...}, ensure_ascii=False)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", "utf-8")
    return str(path)


@pytest.mark.parametrize(
    ("line", "message"),
    [("{not-json", "malformed JSON"), ("", "malformed JSON"), ("[]", "object"), (record(task_type=...), "task_type"), (record(prompt="  "), "prompt"), (record(timestamp="2026-01-02T10:00:00"), "offset"), (record(timestamp=True), "timestamp"), (record(context=[]), "context"), (record(other=1), "other"), (record(response=1), "response")]
    + [(record(context={"a": 0}).replace(": 0", f": {x}"), "malformed JSON") for x in ("NaN", "Infinity", "-Infinity", "1e400")],
)
def test_faults(line, message):
    with pytest.raises(ValueError, match=message):
        parse_trace(line)


def test_counters_and_dead_letters(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", "{not-json", record(), record(prompt="second"), record(trace_id="t2", timestamp=0, context={"b": 1.0, "a": "é"}), "", record(trace_id="t3", timestamp="1700000000"))
    rows, bad, counters = ingest(spark, path)
    assert (counters.read, counters.accepted, counters.invalid, counters.duplicates_skipped, counters.stored) == (6, 4, 2, 1, 3)
    held = {r.trace_id: r for r in rows.collect()}
    assert held["t1"].prompt == " p " and held["t2"].context_json == '{"a":"é","b":1.0}'
    assert [(r.line, "malformed JSON" in r.message) for r in bad.orderBy("line").collect()] == [(1, True), (5, True)]
    again, _, counters = ingest(spark, path, rows)
    assert counters.stored == 0 and again.count() == 0
    texts = {r.trace_id: r.x for r in rows.select("trace_id", utc_text(F.col("timestamp")).alias("x")).collect()}
    assert texts["t1"] == "2026-01-02T14:00:00.500000Z" and texts["t2"] == "1970-01-01T00:00:00.000000Z"
    canonical = rows.filter("trace_id = 't2'").select(payload(rows)).head()[0]
    assert canonical == '{"context":{"a":"é","b":1.0},"metadata":{},"prompt":" p ","response":null,"task_type":"qa","timestamp":"1970-01-01T00:00:00.000000Z","trace_id":"t2"}'


def test_order_is_newest_first(spark, tmp_path):
    times = ("2026-01-01T14:00:00Z", "2026-01-01T10:00:00.500-04:00", "2026-01-01T14:00:00.500001Z")
    rows, _, _ = ingest(spark, write(tmp_path / "a.jsonl", *[record(trace_id=f"t{i}", timestamp=t) for i, t in enumerate(times)]))
    assert [r.trace_id for r in newest_first(rows).collect()] == ["t2", "t1", "t0"]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "bad").write_bytes(record().encode() + b"\n\xff\xfe\n")
    with pytest.raises(IngestError):
        ingest(spark, str(tmp_path / "bad"))


def test_many_lines_are_counted_across_blocks(spark, tmp_path):
    lines = [record(trace_id=f"t{i}") if i % 100 else "x" for i in range(3000)]
    path = write(tmp_path / "a.jsonl", *lines)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        _, bad, counters = ingest(spark, path)
        assert counters.stored == 2970 and [r.line for r in bad.orderBy("line").collect()] == [i + 1 for i in range(0, 3000, 100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_stream_gives_the_batch_result(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    first = [record(prompt="first"), "{bad", record(prompt="second"), record(trace_id="t2"), "", record(trace_id="t2", prompt="again")]
    write(folder / "a", *first)
    batch, bad, _ = ingest(spark, str(folder / "a"))
    stream_traces(spark, str(folder), catalog, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, catalog.read("traces").collect())) == sorted(map(tuple, batch.select(*catalog.read("traces").columns).collect()))
    assert {r.trace_id: r.prompt for r in catalog.read("traces").collect()} == {"t1": "first", "t2": " p "}
    assert sorted(map(tuple, catalog.read("rejects").collect())) == sorted(map(tuple, bad.collect())) and bad.count() == 2
    write(folder / "b", record(prompt="later"), record(trace_id="t3"), "[]")
    stream_traces(spark, str(folder), catalog, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.trace_id, r.prompt) for r in catalog.read("traces").collect()) == [("t1", "first"), ("t2", " p "), ("t3", " p ")]
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in catalog.read("rejects").collect()) == [("a", 2), ("a", 5), ("b", 3)]


def test_stream_counts_lines_across_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [record(trace_id=f"t{i % 900}", prompt=f"p{i}") if i % 100 else "x" for i in range(3000)]
    write(folder / "a", *lines)
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        stream_traces(spark, str(folder), catalog, str(tmp_path / "cp")).awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    want = {}
    for i in range(3000):
        if i % 100:
            want.setdefault(f"t{i % 900}", f"p{i}")
    assert {r.trace_id: r.prompt for r in catalog.read("traces").collect()} == want
    assert sorted(r.line for r in catalog.read("rejects").collect()) == [i + 1 for i in range(0, 3000, 100)]


def test_windows(spark):
    rows = spark.createDataFrame([("2026-01-01 00:01:00", "a"), ("2026-01-01 00:04:59", "a"), ("2026-01-01 00:05:00", "b")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.kind, r.n) for r in windowed_counts(rows, "ts", "kind").collect()) == [("a", 2), ("b", 1)]


def test_every_year_that_a_record_may_have(spark, tmp_path):
    """Times beyond 1677 to 2262, which pandas can't hold, are stored to the microsecond."""
    times = ["0001-01-01T00:00:00Z", "1600-02-29T12:30:00.000001+00:00", "9999-12-31T23:59:59.999999Z", "2024-06-01T02:00:00+02:00"]
    path = write(tmp_path / "a.jsonl", *[record(trace_id=f"t{i}", timestamp=t) for i, t in enumerate(times)], record(trace_id="t9", timestamp="0001-01-01T00:00:00+14:00"))
    rows, bad, counters = ingest(spark, path)
    assert [r.t for r in rows.orderBy("trace_id").select(utc_text(F.col("timestamp")).alias("t")).collect()] == ["0001-01-01T00:00:00.000000Z", "1600-02-29T12:30:00.000001Z", "9999-12-31T23:59:59.999999Z", "2024-06-01T00:00:00.000000Z"]
    assert counters.stored == 4 and [r.line for r in bad.collect()] == [5]  # its moment in UTC has no year


def test_lines_are_numbered_without_moving_them(spark, tmp_path):
    """Blocks of several files are counted, and neither sorted nor shuffled with their lines."""
    from assayer.sources.traces import read_lines

    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}:{i}\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000b")
    try:
        rows = read_lines(spark, str(tmp_path))
        assert {(r.file[-5], r.line, r.value) for r in rows.collect()} == {(str(f), i, f"{f}:{i}") for f in range(3) for i in range(1, 2001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan and "row_number" not in plan
