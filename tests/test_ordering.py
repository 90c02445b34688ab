import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import ordering, sha256_state
from assayer.functions.sha256_state import Sha256


@given(st.lists(st.binary(max_size=200), max_size=6), st.booleans())
def test_a_state_is_taken_up_again(parts, plain):
    digest = Sha256(plain=plain)
    for part in parts:
        digest.update(part)
        digest = Sha256(digest.state(), plain=plain)
    assert digest.hexdigest() == hashlib.sha256(b"".join(parts)).hexdigest()


def test_library_and_python_share_states():
    data = bytes(range(256)) * 9
    for cut in (0, 63, 64, 1000):
        first = Sha256(plain=cut % 2 == 0)
        first.update(data[:cut])
        second = Sha256(first.state(), plain=cut % 2 == 1)
        second.update(data[cut:])
        assert second.hexdigest() == hashlib.sha256(data).hexdigest()
    assert len(set(sha256_state.ROUNDS)) == 64 and sha256_state.START[0] == 0x6A09E667  # the standard's first word


def listed(records):
    return hashlib.sha256(("[" + ",".join(records) + "]").encode()).hexdigest()


@pytest.fixture(params=["one range", "many ranges"])
def ranges(spark, request):
    """Runs a test with ranges as they come, and with many: small tables are kept apart."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    if request.param == "many ranges":
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 10, 4097])
def test_one_digest(spark, ranges, n, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK_BYTES", 300)
    keys = [f"k{i:07}é" for i in range(n)]
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    got = ordering.ordered_digest(rows, F.concat(F.lit('{"k":"'), "k", F.lit('"}')), F.col("k"))
    assert got == listed([f'{{"k":"{k}"}}' for k in sorted(keys)])


def test_owners_of_all_sizes(spark, ranges, monkeypatch):
    """Owners within a range, across two and across many; one without a name; empty records."""
    monkeypatch.setattr(ordering, "CHUNK_BYTES", 100)
    sizes = [1, 3, 2000, 1, 700, 5, 1, 1]
    rows = [(None if o == 3 else f"o{o}", i, "" if i % 11 == 0 else f'"{i}"') for o, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    held = spark.createDataFrame(rows, "name string, at int, rec string")
    got = {r.owner: r.digest for r in ordering.ordered_digests(held, F.col("name"), F.col("rec"), F.col("at")).collect()}
    want = {}
    for o, i, r in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(o, []).append(r)
    assert got == {o: listed(records) for o, records in want.items()}


def test_a_million_records_against_duckdb(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")  # some ranges
    try:
        rows = spark.range(10**6, numPartitions=4).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
        got = ordering.ordered_digest(rows, F.concat(F.lit('"'), "k", F.lit('"')), F.col("k"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    want = duckdb.sql("SELECT sha256('[' || string_agg('\"t' || lpad(i::VARCHAR, 9, '0') || '\"', ',' ORDER BY i) || ']') FROM range(1000000) r(i)").fetchall()[0][0]
    assert got == want


def test_stretches_of_nulls():
    names = pa.array([None, None, 1, 1, 2])
    assert [(a, b, n.as_py()) for a, b, n in ordering._stretches(names)] == [(0, 2, None), (2, 4, 1), (4, 5, 2)]


def test_ranges_of_one_owner_share_a_job(spark, monkeypatch):
    """Ranges behind each other are hashed by one task, as many as have CHUNKS chunks together; owners begin at once."""
    jobs, resumed = [], ordering._resumed
    monkeypatch.setattr(ordering, "_resumed", lambda begun: jobs.append(len(begun)) or resumed(begun))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        rows = spark.range(900).select(F.format_string('"%05d"', "id").alias("r"), "id")
        want = listed([f'"{i:05}"' for i in range(900)])
        for chunks, n in ((256, 1), (3, 4)):
            jobs.clear()
            monkeypatch.setattr(ordering, "CHUNKS", chunks)
            assert ordering.ordered_digest(rows, F.col("r"), F.col("id")) == want
            assert len(jobs) <= n and set(jobs) == {1}
        jobs.clear()
        monkeypatch.setattr(ordering, "CHUNKS", 2)
        three = rows.withColumn("owner", (F.col("id") / 300).cast("int"))
        got = {r.owner: r.digest for r in ordering.ordered_digests(three, F.col("owner"), F.col("r"), F.col("id")).collect()}
        assert got == {k: listed([f'"{i:05}"' for i in range(300 * k, 300 * k + 300)]) for k in range(3)} and len(jobs) <= 3 and jobs[0] >= 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
