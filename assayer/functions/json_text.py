"""Strict and canonical JSON. Open objects go through Python, which alone keeps 1.0 apart from 1."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not a JSON number")


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is beyond the range of JSON numbers")
    return value


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        seen: set[str] = set()
        raise ValueError(f"key {next(k for k, _ in pairs if k in seen or seen.add(k))!r} is repeated")
    return out


def strict_loads(text: str, unique_keys: bool = False) -> Any:
    """json.loads without NaN, infinities and numbers that overflow; on request without repeated keys."""
    hook = {"object_pairs_hook": _no_repeats} if unique_keys else {}
    return json.loads(text, parse_constant=_constant, parse_float=_finite, **hook)


def canonical_dumps(value: Any) -> str:
    """Sorted keys, no spaces, non-ASCII as it is, finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("is_object", T.BooleanType()), T.StructField("keys", T.ArrayType(T.StringType()))]))
def strict_json(s: pd.Series) -> pd.DataFrame:
    """Of each text: whether it is strict JSON, the error, whether it is an object, its top-level keys."""
    rows = []
    for text in s:
        if text is None:
            rows.append((None, None, None, None))
            continue
        try:
            value = strict_loads(text)
        except (ValueError, RecursionError) as error:
            rows.append((False, str(error), False, None))
            continue
        rows.append((True, None, isinstance(value, dict), list(value) if isinstance(value, dict) else None))
    return pd.DataFrame(rows, columns=["valid", "error", "is_object", "keys"])


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """The canonical form of a JSON text, null for what isn't strict JSON."""

    def form(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_dumps(strict_loads(text))
        except (ValueError, RecursionError):
            return None

    return s.map(form)


#: Control characters and what json.dumps writes for them.
CONTROLS = [(chr(i), json.dumps(chr(i))[1:-1]) for i in range(32)]


def quote(col: Column) -> Column:
    """A JSON string as json.dumps writes it, made in the JVM. Only texts with control characters besides ends of lines and tabs are looked through for each."""
    simple = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c in "\n\r\t":
        simple = F.replace(simple, F.lit(c), F.lit(dict(CONTROLS)[c]))
    marks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in CONTROLS if c not in "\n\r\t"])
    escaped = F.aggregate(marks, simple, lambda text, m: F.replace(text, m["c"], m["e"]))
    return F.concat(F.lit('"'), F.when(~col.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), simple).otherwise(escaped), F.lit('"'))


def fixed_object(**fields: Column) -> Column:
    """A canonical JSON object of fields that are JSON already, in the order of their names."""
    parts = [F.concat(F.lit(f'{"," if i else ""}"{k}":'), fields[k]) for i, k in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_bool(col: Column) -> Column:
    return F.when(col, "true").otherwise("false")


# What makes a key's value one to hide.
SECRET_MARKS = ("secret", "password", "token", "api_key", "apikey", "auth")
HIDDEN = "[redacted]"


def redacted(value: Any) -> Any:
    """value with everything below a secret key hidden, at any depth."""
    if isinstance(value, dict):
        return {k: HIDDEN if any(m in k.lower() for m in SECRET_MARKS) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def redact_json(s: pd.Series) -> pd.Series:
    """The canonical form of a JSON text without its secrets; null stays null, other text is hidden whole."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return canonical_dumps(redacted(strict_loads(text)))
        except (ValueError, RecursionError):
            return HIDDEN

    return s.map(clean)
