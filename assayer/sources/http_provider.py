"""A connector to a model behind HTTP: POST /api/generate, one JSON object back.

Requests run where the rows are, PARALLEL of a task at a time; nothing is retried, and an answer that
isn't strictly what was asked for is a typed error that fails the stage. With a journal, each request
is written down before and after, and a task that runs again asks only for what has no answer yet.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.functions.json_text import strict_loads
from assayer.sources.journal import Journal, pooled, request_key

#: Requests of a task that wait for an answer at once, and rows of a batch.
PARALLEL = 4

# What of a response's metadata is kept, texts and counts.
TEXTS = ("model", "created_at", "done_reason")
COUNTS = ("total_duration", "load_duration", "prompt_eval_count", "prompt_eval_duration", "eval_count", "eval_duration")


class ProviderError(RuntimeError):
    """A request that failed; code is transport, status, response or timeout."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def base_url(text: str) -> str:
    """A service's address in its normal form: scheme and host lower-cased, no path, query or login."""
    parts = urlsplit(text.strip())
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname or parts.username or parts.query or parts.fragment or parts.path not in ("", "/"):
        raise ValueError(f"{text!r} must be an http address of a host alone")
    port = f":{parts.port}" if parts.port else ""
    host = f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname.lower()
    return f"{parts.scheme.lower()}://{host}{port}"


def said(value: Any) -> str | None:
    """What a service says went wrong, if it does."""
    text = value.get("error") if isinstance(value, dict) else None
    return text if isinstance(text, str) and text.strip() else None


def metadata_of(value: dict[str, Any]) -> dict[str, Any]:
    """What is kept beside a finished output; ValueError where a field has another type than it should."""
    out: dict[str, Any] = {"done": True}
    for names, right, what in ((TEXTS, lambda v: isinstance(v, str), "text"), (COUNTS, lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0, "a whole number from 0")):
        for name in names:
            if value.get(name) is not None:
                if not right(value[name]):
                    raise ValueError(f"{name} must be {what}")
                out[name] = value[name]
    return out


@dataclass(frozen=True)
class HttpProvider:
    """One model with fixed settings. as_json asks for a JSON answer, as judges do."""

    url: str
    model: str
    temperature: float = 0.0
    #: Null leaves the seed to the service.
    seed: int | None = 42
    timeout: float = 120.0
    as_json: bool = False

    def generate(self, eval_id: str, prompt: str) -> tuple[str, dict[str, Any], float]:
        """(output, metadata, milliseconds); an empty output is one too."""
        body: dict[str, Any] = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature} | ({} if self.seed is None else {"seed": self.seed})}
        if self.as_json:
            body["format"] = "json"
        request = urllib.request.Request(f"{base_url(self.url)}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})  # noqa: S310  the scheme is checked
        began = time.perf_counter()
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                raw = answer.read()
        except TimeoutError as error:
            raise ProviderError("timeout", f"{eval_id}: no answer in {self.timeout:g} s") from error
        except urllib.error.HTTPError as error:
            try:
                detail = said(json.loads(error.read().decode("utf-8")))
            except (OSError, ValueError):
                detail = None
            raise ProviderError("status", f"{eval_id}: {error.code} {detail or error.reason}") from error
        except (urllib.error.URLError, OSError) as error:
            raise ProviderError("timeout" if isinstance(getattr(error, "reason", None), TimeoutError) else "transport", f"{eval_id}: {error}") from error
        took = (time.perf_counter() - began) * 1000
        try:
            value = strict_loads(raw.decode("utf-8"))
        except ValueError as error:
            raise ProviderError("response", f"{eval_id}: {error}") from error
        if detail := said(value):
            raise ProviderError("response", f"{eval_id}: {detail}")
        if not isinstance(value, dict) or not isinstance(value.get("response"), str) or value.get("done") is not True:
            raise ProviderError("response", f"{eval_id}: a finished response is needed")
        try:
            return value["response"], metadata_of(value), took
        except ValueError as error:
            raise ProviderError("response", f"{eval_id}: {error}") from error


def _asked(journal: Journal | None, provider: HttpProvider, role: str, eval_id: str, prompt: str) -> tuple[str, dict[str, Any], float]:
    """(output, metadata, milliseconds) of a request, from the journal where it has them."""
    if journal is None:
        return provider.generate(eval_id, prompt)
    key = request_key(role, eval_id, prompt, provider.url, provider.model, provider.temperature, provider.seed, provider.as_json)
    return tuple(journal.asked(key, role, eval_id, lambda: list(provider.generate(eval_id, prompt))))


def generate(rows: DataFrame, provider: HttpProvider, journal: Journal | None = None) -> DataFrame:
    """(role, eval_id, output, latency_ms, metadata) of rows (role, eval_id, prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pooled(batch, PARALLEL, lambda r: _asked(journal, provider, r["role"], r["eval_id"], r["prompt"]))
            told = [pa.array([m[0] for m in made], pa.string()), pa.array([float(m[2]) for m in made], pa.float64()), pa.array([json.dumps(m[1], sort_keys=True) for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], ["role", "eval_id", "output", "latency_ms", "metadata"])

    return rows.select("role", "eval_id", "prompt").mapInArrow(run, "role string, eval_id string, output string, latency_ms double, metadata string")


def judge(rows: DataFrame, provider: HttpProvider, retry_prompt: str, journal: Journal | None = None) -> DataFrame:
    """(role, eval_id, outputs) of rows (role, eval_id, prompt, rubric): a malformed answer is asked for once more."""
    from assayer.operators.judging import MAX_ATTEMPTS, JudgeError, parse_response

    def answers(row: dict[str, Any]) -> list[str]:
        got: list[str] = []
        prompt = row["prompt"]
        while len(got) < MAX_ATTEMPTS:
            got.append(_asked(journal, provider, row["role"], row["eval_id"], prompt)[0])
            try:
                parse_response(got[-1], row["rubric"])
            except JudgeError as error:
                prompt = f"{retry_prompt.rstrip()}\n\nError: {error}\n\n{prompt}"
            else:
                break
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(pooled(batch, PARALLEL, answers), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["role", "eval_id", "outputs"])

    return rows.select("role", "eval_id", "prompt", "rubric").mapInArrow(run, "role string, eval_id string, outputs array<string>")
