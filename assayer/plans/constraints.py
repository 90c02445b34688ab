"""Constraints as expressions and violation tables: what a write must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import nonblank

HASH = r"^[0-9a-f]{64}$"
# The legal values of coded columns.
CODES = {
    "evaluation_mode": ("deterministic", "reference", "rubric"),
    "priority": ("low", "medium", "high", "critical"),
    "role": ("baseline", "candidate"),
    "experiment_status": ("running", "completed", "failed"),
    "run_status": ("pending", "running", "completed", "failed", "skipped"),
    "verdict": ("PASS", "FAIL"),
    "cache_status": ("hit", "miss", "not_recorded"),
}


class ConstraintError(ValueError):
    """Rows that break a rule; the message has some of them."""


def is_code(col: Column, name: str) -> Column:
    return F.coalesce(col.isin(*CODES[name]), F.lit(False))


def is_hash(col: Column) -> Column:
    return col.rlike(HASH)


def is_share(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & col.between(0, 1)


def _filled(name: str) -> Column:
    return F.coalesce(F.size(name) > 0, F.lit(False))


def case_shape() -> Column:
    """Whether a case has what its mode needs and nothing that other modes need."""
    answer, response = F.coalesce(nonblank(F.col("reference_answer")), F.lit(False)), F.col("source_response").isNotNull()
    none = F.col("reference_answer").isNull() & ~response
    return (
        F.when(F.col("evaluation_mode") == "deterministic", _filled("scorers") & ~_filled("rubric") & none)
        .when(F.col("evaluation_mode") == "reference", answer & ~_filled("scorers") & ~_filled("rubric"))
        .when(F.col("evaluation_mode") == "rubric", _filled("rubric") & ~_filled("scorers") & none)
        .otherwise(F.lit(False))
    )


def experiment_state() -> Column:
    """Legal combinations of an experiment's status and the columns that go with it."""
    done, verdict, failed = F.col("completed_at").isNotNull(), F.col("verdict").isNotNull(), F.col("failure_stage").isNotNull() & F.col("failure_message").isNotNull()
    return (
        F.when(F.col("status") == "running", ~done & ~verdict & ~failed)
        .when(F.col("status") == "completed", done & is_code(F.col("verdict"), "verdict") & ~failed)
        .when(F.col("status") == "failed", done & ~verdict & failed)
        .otherwise(F.lit(False))
    )


def run_state() -> Column:
    """The same for a run: it starts before it ends, and only a failed one has a message."""
    began, ended, failed = F.col("started_at").isNotNull(), F.col("completed_at").isNotNull(), F.col("failure_message").isNotNull()
    return (
        F.when(F.col("status") == "pending", ~began & ~ended & ~failed)
        .when(F.col("status") == "running", began & ~ended & ~failed)
        .when(F.col("status") == "completed", began & ended & ~failed)
        .when(F.col("status") == "failed", began & ended & failed)
        .when(F.col("status") == "skipped", ~began & ended & ~failed)
        .otherwise(F.lit(False))
    )


#: From a run's status to those that may follow.
NEXT = {"pending": ("running", "skipped"), "running": ("completed", "failed"), "completed": (), "failed": (), "skipped": ()}


def scorer_list() -> Column:
    """Whether scorers is a list of a name and a configuration object each."""
    return F.forall("scorers", lambda s: nonblank(s["name"]) & F.coalesce(F.ltrim(s["config"]).startswith("{"), F.lit(False)))


def rubric_list() -> Column:
    """Whether the criteria are filled and differ."""
    return F.forall("rubric", nonblank) & (F.size(F.array_distinct(F.transform("rubric", lambda r: F.btrim(r)))) == F.size("rubric"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key isn't null and has no parent."""
    known = parent.select(F.col(parent_key or key).alias("_p")).distinct()
    return child.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_p"), "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def changed_provenance(provenance: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Provenance whose columns differ from the source's, nulls being equal, or that has no source."""
    other = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.col("_k").isNotNull()
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return provenance.join(other, F.col(key) == F.col("_k"), "left").filter(~same).select(*provenance.columns)


def incomplete_builds(builds: DataFrame, cases: DataFrame, provenance: DataFrame) -> DataFrame:
    """Sealed builds (dataset_id, sampled_size) whose cases or provenance don't number as many."""
    count = lambda df, n: df.groupBy("dataset_id").agg(F.countDistinct("eval_id").alias(n))
    rows = builds.join(count(cases, "cases"), "dataset_id", "left").join(count(provenance, "provenance"), "dataset_id", "left")
    found = lambda n: F.coalesce(n, F.lit(0))
    return rows.filter((found("cases") != F.col("sampled_size")) | (found("provenance") != F.col("sampled_size")))


def current_status(events: DataFrame, owner: str) -> DataFrame:
    """The status of each owner after its last event by sequence."""
    return events.groupBy(owner).agg(F.max_by("status", "sequence").alias("status"), F.max("sequence").alias("sequence"))


def check(rows: DataFrame, rule: Column, what: str) -> DataFrame:
    """rows, after none of them breaks the rule; ConstraintError otherwise."""
    bad = rows.filter(~F.coalesce(rule, F.lit(False))).limit(3).collect()
    if bad:
        raise ConstraintError(f"{what}: {[r.asDict() for r in bad]}")
    return rows


def check_empty(bad: DataFrame, what: str) -> None:
    if found := bad.limit(3).collect():
        raise ConstraintError(f"{what}: {[r.asDict() for r in found]}")


def slice_membership(aggregates: DataFrame, members: DataFrame) -> DataFrame:
    """Slice aggregates (cluster_number, case_count) whose count isn't the number of the slice's members."""
    held = members.groupBy("cluster_number").agg(F.countDistinct("eval_id").alias("members"))
    return aggregates.join(held, "cluster_number", "left").filter(F.coalesce("members", F.lit(0)) != F.col("case_count"))


def violation_scopes(violations: DataFrame, modes: DataFrame, slices: DataFrame) -> DataFrame:
    """Violations of a scope that isn't global, a mode of the dataset or one of its slices. modes: evaluation_mode; slices: selector."""
    known = modes.select(F.col("evaluation_mode").alias("scope"), F.lit("mode").alias("scope_kind")).unionByName(slices.select(F.col("selector").alias("scope"), F.lit("slice").alias("scope_kind"))).distinct()
    return violations.filter("scope_kind != 'global' or scope != 'global'").join(known, ["scope", "scope_kind"], "left_anti")


def foreign_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results whose case isn't the dataset's, or has another mode. cases: eval_id, evaluation_mode."""
    return results.join(cases.select("eval_id", "evaluation_mode"), ["eval_id", "evaluation_mode"], "left_anti")


def judge_mismatches(judged: DataFrame, lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Judge results without a lookup of their key, hits that the cache doesn't hold, and critical flags that aren't (critical and failed)."""
    rows = judged.join(lookups.select("run_id", "eval_id", "cache_key", "cache_status"), ["run_id", "eval_id"], "left")
    rows = rows.join(cache.select("cache_key").distinct().withColumn("held", F.lit(True)), "cache_key", "left")
    flag = F.array_contains("review_reasons", "critical_failure")
    wrong = F.col("cache_status").isNull() | ((F.col("cache_status") == "hit") & F.col("held").isNull()) | (flag != ((F.col("priority") == "critical") & ~F.col("passed")))
    return rows.filter(wrong).select("run_id", "eval_id")


def assignment_faults(assigned: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose assignments leave the range of clusters or of document indexes, or are more than its traces."""
    rows = assigned.join(runs, "clustering_run_id")
    outside = ~F.col("cluster_number").between(0, F.col("cluster_count") - 1) | ~F.col("document_index").between(0, F.col("trace_count") - 1)
    found = rows.groupBy("clustering_run_id").agg(F.count_if(outside).alias("outside"), (F.count("*") > F.max("trace_count")).alias("too_many"), (F.countDistinct("document_index") < F.count("*")).alias("repeated"))
    return found.filter("outside > 0 or too_many or repeated")


def label_updates(versions: DataFrame) -> DataFrame:
    """Label versions that change the label and not its key, or the key and not the label, or don't come later."""
    w = Window.partitionBy("clustering_run_id", "cluster_number").orderBy("version")
    rows = versions.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("label", "label_key", "updated_at", "version")}).filter("last_version is not null")
    return rows.filter(F.col("label").eqNullSafe(F.col("last_label")) | (F.col("updated_at") < F.col("last_updated_at")) | (F.col("label").isNull() != F.col("label_key").isNull()))
