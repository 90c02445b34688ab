"""Hashes and identifiers as JVM expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.json_text import canonical_dumps, quote

# The namespaces of dataset and case identifiers.
DATASET_NAMESPACE = "4dc9af25-7cdb-5d6b-a985-318ecdea4f55"
CASE_NAMESPACE = "b272f60f-9f27-5152-a2d5-80e6e4e77341"


def sha256(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def uuid5_hex(namespace: str, name: Column) -> Column:
    """The 32 hex digits of a version 5 UUID: sha1 with version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(F.lit("["), quote(a), F.lit(","), quote(b), F.lit("]"))


def eval_id(dataset_id: Column, trace_id: Column) -> Column:
    return F.concat(F.lit("eval_"), uuid5_hex(CASE_NAMESPACE, _pair(dataset_id, trace_id)))


def dataset_id(name: str, version: str) -> str:
    """Name and version are stripped first."""
    pair = canonical_dumps([name.strip(), version.strip()])
    return "dataset_" + uuid.uuid5(uuid.UUID(DATASET_NAMESPACE), pair).hex
