"""A journal of requests: each is written down before it is made and after it is answered.

Executors write it to a folder that they share, so a task that runs again, wherever that is, finds the
answers of the one before it and asks only for those that are missing. A request is known by its key, a
hash of all that was asked. Its files are <key>.<attempt>.begun, .failed, and <key>.answer.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.json_text import canonical_dumps

ENTRY = "key string, role string, eval_id string, attempt int, event string, at string, error string"


def request_key(*parts: Any) -> str:
    return hashlib.sha256(canonical_dumps(list(parts)).encode()).hexdigest()


@dataclass(frozen=True)
class Journal:
    """A folder of one stage's requests, by an address that Arrow's file systems reach."""

    root: str

    def _at(self) -> tuple[fs.FileSystem, str]:
        if self.root not in _OPEN:
            _OPEN[self.root] = fs.FileSystem.from_uri(self.root)
        return _OPEN[self.root]

    def _write(self, name: str, value: dict[str, Any]) -> None:
        """A file that appears whole."""
        system, home = self._at()
        folder = f"{home}/{name[:2]}"
        system.create_dir(folder, recursive=True)
        staged = f"{folder}/_{name}.{threading.get_ident()}"
        with system.open_output_stream(staged) as out:
            out.write(json.dumps(value).encode())
        system.move(staged, f"{folder}/{name}")

    def _read(self, name: str) -> dict[str, Any] | None:
        system, home = self._at()
        path = f"{home}/{name[:2]}/{name}"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as held:
            return json.loads(held.read().decode())

    def asked(self, key: str, role: str, eval_id: str, call: Callable[[], Any]) -> Any:
        """The answer that the journal has, or that of call(), which is written down before and after."""
        if (held := self._read(f"{key}.answer")) is not None:
            return held["answer"]
        attempt = 1
        while self._read(f"{key}.{attempt}.begun") is not None:
            attempt += 1
        entry = {"key": key, "role": role, "eval_id": eval_id, "attempt": attempt}
        self._write(f"{key}.{attempt}.begun", entry | {"event": "begun", "at": _now()})
        try:
            answer = call()
        except Exception as error:
            self._write(f"{key}.{attempt}.failed", entry | {"event": "failed", "at": _now(), "error": str(error)[:500]})
            raise
        self._write(f"{key}.answer", entry | {"event": "answered", "at": _now(), "answer": answer})
        return answer

    def entries(self, spark: SparkSession) -> DataFrame:
        """(key, role, eval_id, attempt, event, at, error) of all that was written down: begun, failed or answered."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], ENTRY)
        lines = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(self.root)
        return lines.select(F.from_json("value", ENTRY).alias("e")).select("e.*")


_OPEN: dict[str, tuple[fs.FileSystem, str]] = {}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


def pooled(rows: pa.RecordBatch, parallel: int, ask: Callable[[dict[str, Any]], Any]) -> list[Any]:
    """ask of each row, so many at a time; where one fails the others that were begun are finished first."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(parallel) as pool:
        begun = [pool.submit(ask, row) for row in rows.to_pylist()]
        try:
            return [b.result() for b in begun]
        except BaseException:
            for b in begun:
                b.cancel()
            raise
