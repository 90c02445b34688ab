"""Exports in order: ranges by executors, one file, the same lines as a plain version makes."""

import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from assayer.functions.ids import dataset_id
from assayer.functions.json_text import canonical_dumps
from assayer.plans import export
from assayer.plans.store import Catalog, StoreError
from assayer.schemas import schema


def filled(spark, catalog, n):
    """A dataset of n cases of all modes, in no order."""
    made = catalog.create_dataset("many", "1", "déjà   vu")
    number = F.col("id")
    name = F.concat(F.lit("e"), F.lpad((number * 7919 % n).cast("string"), 9, "0"))
    mode = F.when(number % 3 == 0, "reference").when(number % 3 == 1, "rubric").otherwise("deterministic")
    answer = F.when(mode == "reference", F.concat(F.lit("答 \"\\\n"), number))
    scorers = F.when(mode == "deterministic", F.array(F.struct(F.lit("regex").alias("name"), F.lit('{"pattern":"é"}').alias("config"))))
    rows = spark.range(n, numPartitions=5).select(
        name.alias("eval_id"), F.lit(made).alias("dataset_id"), F.concat(F.lit("t"), number).alias("source_trace_id"), mode.alias("evaluation_mode"), F.lit("high").alias("priority"), F.lit("draft").alias("review_status"), F.lit("chat").alias("task_type"),
        F.concat(F.lit("p\t"), number).alias("prompt"), F.lit("{}").alias("context_json"), scorers.alias("scorers"), F.when(mode == "rubric", F.array(F.lit("clear"))).alias("rubric"), answer.alias("reference_answer"), answer.alias("source_response"),
    )
    catalog.commit("cases", rows)
    return made


def plain_case(row):
    value = {k: v for k, v in row.asDict(True).items() if v is not None}
    return canonical_dumps({"record_type": "case", **value})


def test_lines_are_those_of_a_plain_version(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    made = filled(spark, catalog, 301)
    path = tmp_path / "out.jsonl"
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        export.export_dataset(catalog, made, str(path))
        lines = path.read_bytes().decode().split("\n")
        assert lines.pop() == "" and lines == list(export.dataset_lines(catalog, made))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert json.loads(lines[0])["description"] == "déjà   vu"
    assert lines[1:] == [plain_case(r) for r in sorted(catalog.read("cases").collect(), key=lambda r: r.eval_id)]
    with pytest.raises(StoreError, match="exists"):
        export.export_dataset(catalog, made, str(path))
    export.export_dataset(catalog, made, str(path), overwrite=True)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".out")] == []
    with pytest.raises(StoreError, match="doesn't exist"):
        export.export_dataset(catalog, dataset_id("none", "1"), str(tmp_path / "x"))


def test_many_cases_pass_the_driver_by(spark, tmp_path):
    """The driver's Python holds no list of cases."""
    catalog = Catalog(spark, f"file://{tmp_path}/store")
    made = filled(spark, catalog, 200_000)
    tracemalloc.start()
    export.export_dataset(catalog, made, str(tmp_path / "out"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    with open(tmp_path / "out", encoding="utf-8") as lines:
        next(lines)
        last, n = "", 0
        for line in lines:
            name = json.loads(line)["eval_id"]
            assert last < name
            last, n = name, n + 1
    assert n == 200_000 and schema("cases")
