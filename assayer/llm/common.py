"""What the operators of this subpackage share: words, scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.shared import forget, scratch, written

__all__ = ["MIX1", "SPACES", "blobs", "forget", "lean", "meet", "mixed", "one_thread", "scratch", "small_batches", "table", "uniform", "words", "written"]

#: What separates words: space and the control characters 9 to 13. The same set that bytes.split() uses.
SPACES = r"[\x20\x09-\x0D]+"
MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


#: Keys of more rows than the first are met by broadcast; no more keys than the second ever are.
HOT_ROWS, HOT_KEYS = 1024, 2**17


def meet(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with the row of their key in per_key, without a task for all rows of a hot key.

    per_key has a row for each key, stored, with the count of rows that have it; total is the number
    of rows. Keys of more than HOT_ROWS rows, and than a HOT_KEYS-th of all rows, are hot: there are
    HOT_KEYS of them at most, so they are broadcast and their rows stay where they are. The others
    are joined by a shuffle.
    """
    hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    if per_key.filter(hot).isEmpty():
        return rows.join(per_key, key)
    often = F.broadcast(per_key.filter(hot))
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(per_key.filter(~hot), key))


#: Rows of a batch that is read or goes to Python: texts are long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Sets batches of Arrow and of the Parquet reader of BATCH_ROWS rows for the session, where it has larger ones."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, b"" for a null, without decoding."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type):
            kind, offset_type = pa.large_binary(), np.int64
        else:
            kind, offset_type = pa.binary(), np.int32
        part = part.cast(kind)
        _, offsets, data = part.buffers()
        if not len(part):
            continue
        at = np.frombuffer(offsets, offset_type)[part.offset : part.offset + len(part) + 1].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        valid = part.is_valid().to_pylist() if part.null_count else None
        for i in range(len(part)):
            yield b"" if valid and not valid[i] else bytes(view[at[i] : at[i + 1]])


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX2
    x = x ^ (x >> np.uint64(27))
    x = x * MIX3
    return x ^ (x >> np.uint64(31))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone, the same on any machine."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def lean(run):
    """run, a function over Arrow batches, on one thread, that gives memory back to the system at its end.

    Python workers outlive their tasks; what one stage freed shouldn't be held against the next.
    """

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


_SET: list[bool] = []


def one_thread() -> None:
    """Keeps numpy's matrix products in a Python worker to one thread.

    A task has one core; more threads would wait for each other, at the cost of other tasks. Where
    the library isn't found, nothing changes but the time that takes.
    """
    maps = Path("/proc/self/maps")
    if _SET or not maps.exists():
        return
    _SET.append(True)
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line}:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if found := getattr(library, name, None):
                found(1)
