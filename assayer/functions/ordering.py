"""Places and digests of rows in an order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.sha256_state import Sha256
from assayer.functions.shared import scratch, written

#: Bytes of records in a stored chunk, besides those of its last batch.
CHUNK_BYTES = 1 << 20
#: Chunks of ranges that stand behind each other, which one task hashes at once.
CHUNKS = 256


def document_index(rows: DataFrame, key: str = "trace_id") -> DataFrame:
    """rows with document_index, their place in the order of key, without one sorting task.

    Keys are cut into sorted ranges, which are written once with their range and place: both the
    counts of ranges and the rows are read from there, so no second plan can cut them differently.
    A range's rows start behind the rows of all before it. Rows that repeat a key stand side by side.
    """
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)), "document-index")
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}  # a row for each range
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    placed = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return ranged.join(F.broadcast(placed), "_part", "left").withColumn("document_index", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def ordered_digest(rows: DataFrame, record: Column, order: Column) -> str:
    """sha256 of the JSON list of all records (JSON texts) in ascending order of order, however many there are."""
    found = ordered_digests(rows, F.lit(0), record, order).head()
    return found["digest"] if found else _closed(_opened())


def _opened() -> bytes:
    """The state of a list without records so far."""
    begin = Sha256()
    begin.update(b"[")
    return begin.state()


def ordered_digests(rows: DataFrame, owner: Column, record: Column, order: Column) -> DataFrame:
    """(owner, digest): sha256 of the JSON list of each owner's records in ascending order of order.

    order is each row's own within its owner; a null record stands as null. Rows are cut into ranges of (owner, order). A range
    hashes what it can: the state of a digest that begins within it is all it leaves of that owner. Of
    its first owner, which may have begun before, it stores the records' bytes in chunks. These are
    hashed from the state that the range before has left: of each owner, as many ranges as have CHUNKS
    chunks together, the first ones of all owners at once, then those that waited for these, and so on. So
    jobs are as many as the largest owner has such stretches, and no task holds more than a chunk besides what
    Spark sorts. The driver keeps a few rows a range.
    """
    spark = rows.sparkSession
    held = rows.select(owner.alias("owner"), order.alias("o"), F.coalesce(record, F.lit("null")).alias("r"))
    kind = held.schema["owner"].dataType.simpleString()
    ranged = held.repartitionByRange("owner", "o").sortWithinPartitions("owner", "o").select("owner", "r")
    path = scratch(spark, "digests")
    fields = f"part int, step int, owner {kind}, chunk binary, state binary, digest string"
    ranged.mapInArrow(_begun, fields).write.partitionBy("part").parquet(path)
    stored = spark.read.schema(fields).parquet(path)
    ends: dict[int, dict[str, Any]] = {}  # of each range: its first owner and, where there are more, its last one's state
    chunk, state = F.when(F.col("chunk").isNotNull(), F.col("step")), F.when(F.col("state").isNotNull(), 1)
    begun = stored.filter("digest is null").groupBy("part").agg(F.min_by("owner", chunk).alias("first"), (F.max(chunk) + 1).alias("chunks"), F.max_by(F.struct("owner", "state"), state).alias("last"))
    for r in begun.collect():  # a row for each range
        ends[r["part"]] = {"first": (r["first"], None), "chunks": r["chunks"]} | ({"last": tuple(r["last"])} if r["last"] is not None else {})
    states = _handed_on(stored, ends)
    finals = []
    parts = sorted(ends)
    for i, here in enumerate(parts):
        after = parts[i + 1] if i + 1 < len(parts) else None
        goes_on = after is not None and ends[after]["first"][0] == ends[here].get("last", ends[here]["first"])[0]
        if "last" in ends[here]:
            finals.append((ends[here]["first"][0], states[here]))
            if not goes_on:
                finals.append(ends[here]["last"])
        elif not goes_on:
            finals.append((ends[here]["first"][0], states[here]))
    closed = [(name, _closed(state)) for name, state in finals]
    complete = stored.filter("digest is not null").select("owner", "digest")
    return complete.unionByName(spark.createDataFrame(closed, f"owner {kind}, digest string")) if closed else complete


def _closed(state: bytes) -> str:
    end = Sha256(state)
    end.update(b"]")
    return end.hexdigest()


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its first owner's records in chunks, the digests of owners within, the state of the last one."""
    part, first, step, owner, held, size, digest = TaskContext.get().partitionId(), True, 0, None, [], 0, None

    def row(of: pa.Scalar, **columns: Any) -> pa.RecordBatch:
        kinds = {"step": pa.int32(), "chunk": pa.binary(), "state": pa.binary(), "digest": pa.string()}
        made = {"part": pa.array([part], pa.int32()), "owner": pa.array([of.as_py()], of.type)}
        made |= {k: pa.array([columns.get(k)], kind) for k, kind in kinds.items()}
        return pa.RecordBatch.from_pydict({k: made[k] for k in ("part", "step", "owner", "chunk", "state", "digest")})

    for batch in batches:
        for start, end, name in _stretches(batch.column(0)):
            joined = _joined(batch.column(1).slice(start, end - start))
            if owner is None:
                owner = name
            elif not name.equals(owner):
                if first and (held or not step):
                    yield row(owner, step=step, chunk=b",".join(held))
                elif not first:
                    digest.update(b"]")
                    yield row(owner, digest=digest.hexdigest())
                first, owner, digest = False, name, None
            if first:
                held.append(joined)
                size += len(joined)
                if size >= CHUNK_BYTES:
                    yield row(owner, step=step, chunk=b",".join(held))
                    held, size, step = [], 0, step + 1
            else:
                if digest is None:
                    digest = Sha256(_opened())
                else:
                    digest.update(b",")
                digest.update(joined)
    if first and held:
        yield row(owner, step=step, chunk=b",".join(held))
    elif not first:
        yield row(owner, step=-1, state=digest.state())


def _stretches(names: pa.Array) -> Iterator[tuple[int, int, pa.Scalar]]:
    """(start, end, name) of the stretches of equal names."""
    coded = pc.run_end_encode(names)
    start = 0
    for end, name in zip(coded.run_ends.to_pylist(), coded.values, strict=True):
        yield start, end, name
        start = end


def _joined(records: pa.Array) -> bytes:
    listed = pa.ListArray.from_arrays(pa.array([0, len(records)], pa.int32()), records.cast(pa.string()))
    return pc.binary_join(listed, ",")[0].as_buffer().to_pybytes()


def _handed_on(stored: DataFrame, ends: dict[int, dict[str, Any]]) -> dict[int, bytes]:
    """The state that each range's first owner has at the range's end."""
    spark = stored.sparkSession
    waves: list[dict[int, list[int]]] = []  # stretches of ranges by the number of stretches that they wait for: the first range and all
    level, head, size, before = 0, 0, 0, None
    for part in sorted(ends):
        last = ends[before].get("last", ends[before]["first"])[0] if before is not None else None
        follows = before is not None and last == ends[part]["first"][0]
        ends[part]["begin"] = ends[before].get("last", (None, None))[1] if follows else _opened()  # None: the range before has it
        ends[part]["joined"], ends[part]["before"] = follows, before
        size += ends[part]["chunks"]
        if not follows or "last" in ends[before]:
            level, head, size = 0, part, ends[part]["chunks"]
        elif size > CHUNKS:
            level, head, size = level + 1, part, ends[part]["chunks"]
        waves += [{}] if level == len(waves) else []
        waves[level].setdefault(head, []).append(part)
        before = part
    states: dict[int, bytes] = {}
    for wave in waves:
        begun = {p: (ends[p]["begin"] or states[ends[p]["before"]], ends[p]["joined"]) for p in wave}
        heads = spark.createDataFrame([(p, h) for h, parts in wave.items() for p in parts], "part int, head int")
        chunks = stored.filter(F.col("part").isin([p for parts in wave.values() for p in parts]) & F.col("chunk").isNotNull()).select("part", "step", "chunk")
        dealt = chunks.join(F.broadcast(heads), "part").repartition(len(wave), "head").select("part", "step", "chunk") if len(wave) > 1 else chunks.coalesce(1)
        found = dealt.sortWithinPartitions("part", "step").mapInArrow(_resumed(begun), "part int, state binary").collect()
        states |= {r["part"]: bytes(r["state"]) for r in found}
    return states


def _resumed(begun: dict[int, tuple[bytes, bool]]):
    """A function over sorted chunks (part, step, chunk): each part's state behind its chunks.

    begun: of parts that begin a stretch, the state before and whether a record stands there. Other parts go on where the part before ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, bytes] = {}
        at, digest = None, Sha256()
        for batch in batches:
            for part, step, chunk in zip(*(batch.column(i) for i in range(3)), strict=True):
                part = part.as_py()
                if part != at:
                    states |= {} if at is None else {at: digest.state()}
                    at, digest = part, Sha256(begun[part][0]) if part in begun else digest
                if step.as_py() or part not in begun or begun[part][1]:
                    digest.update(b",")
                digest.update(chunk.as_buffer().to_pybytes())
        states |= {} if at is None else {at: digest.state()}
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int32()), pa.array(list(states.values()), pa.binary())], ["part", "state"])

    return run
