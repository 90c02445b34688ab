"""Balanced, deterministic sampling of slices into evaluation datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.ids import eval_id, sha256
from assayer.functions.json_text import fixed_object, json_bool, quote
from assayer.functions.ordering import ordered_digests
from assayer.functions.numbers import count_if
from assayer.functions.text import nonblank

# Fixed value: the algorithm's name is part of every key.
ALGORITHM = "balanced-preference-hash-v1"


class SamplingError(ValueError):
    """A sample that can't be drawn."""


def history_signals(cases: DataFrame, results: DataFrame, runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """(trace_id, critical_priority_signal, prior_failure_signal) of traces that have one.

    A trace is critical if any case made of it is; it failed before if, in a completed run of a
    completed experiment, in either role, any result of such a case failed.
    """
    done = runs.filter(F.col("status") == "completed").join(experiments.filter(F.col("status") == "completed").select("experiment_id"), "experiment_id", "left_semi")
    failed = results.filter(~F.col("passed")).join(done.select("run_id"), "run_id", "left_semi").select("eval_id").distinct().withColumn("failed", F.lit(True))
    rows = cases.join(failed, "eval_id", "left")
    signals = rows.groupBy(F.col("source_trace_id").alias("trace_id")).agg(
        F.coalesce(F.bool_or(F.col("priority") == "critical"), F.lit(False)).alias("critical_priority_signal"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("prior_failure_signal")
    )
    return signals.filter("critical_priority_signal or prior_failure_signal")


def selection_key(config_hash: Column, manifest_hash: Column) -> Column:
    """Of rows with cluster_number, hashes, signals and preference_tier."""
    return sha256(
        fixed_object(
            algorithm=F.lit(f'"{ALGORITHM}"'),
            cluster_number=F.col("cluster_number").cast("string"),
            clustering_configuration_hash=quote(config_hash),
            clustering_source_manifest_hash=quote(manifest_hash),
            critical_priority_signal=json_bool(F.col("critical_priority_signal")),
            document_hash=quote(F.col("document_hash")),
            preference_tier=F.col("preference_tier").cast("string"),
            prior_failure_signal=json_bool(F.col("prior_failure_signal")),
            source_trace_hash=quote(F.col("source_trace_hash")),
            trace_id=quote(F.col("trace_id")),
        )
    )


def allocation_key(config_hash: Column, manifest_hash: Column) -> Column:
    return sha256(fixed_object(algorithm=F.lit(f'"{ALGORITHM}"'), cluster_number=F.col("cluster_number").cast("string"), clustering_configuration_hash=quote(config_hash), source_manifest_hash=quote(manifest_hash)))


def eligible(assigned: DataFrame, signals: DataFrame, config_hash: str, manifest_hash: str) -> DataFrame:
    """Assigned traces with a response that isn't blank, their signals, tier (2 minus one for each signal) and keys.

    assigned: trace_id, cluster_number, response, document_hash, source_trace_hash.
    """
    rows = assigned.filter(nonblank(F.col("response"))).join(signals, "trace_id", "left")
    rows = rows.withColumns({s: F.coalesce(s, F.lit(False)) for s in ("critical_priority_signal", "prior_failure_signal")})
    rows = rows.withColumn("preference_tier", F.lit(2) - F.col("critical_priority_signal").cast("int") - F.col("prior_failure_signal").cast("int"))
    return rows.withColumns({"selection_key": selection_key(F.lit(config_hash), F.lit(manifest_hash)), "allocation_key": allocation_key(F.lit(config_hash), F.lit(manifest_hash))})


def quotas(candidates: DataFrame, size: int) -> DataFrame:
    """(cluster_number, allocation_key, eligible_count, critical_count, failure_count, quota).

    The round robin in closed form: slices take turns in the order of their allocation key while
    they last, so a slice's turn r comes at the place of (r, key) among all turns. A slice has as
    many turns as eligible rows, but never more than size, and the first size turns are taken. The
    full rounds come from the counts alone: a table of slices is all that is sorted.
    """
    counts = candidates.groupBy("cluster_number", "allocation_key").agg(F.count("*").alias("eligible_count"), count_if(F.col("critical_priority_signal")).alias("critical_count"), count_if(F.col("prior_failure_signal")).alias("failure_count"))
    by_count = Window.orderBy("eligible_count", "cluster_number")
    before = F.coalesce(F.sum("eligible_count").over(by_count.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.count("*").over(by_count.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # rounds that all slices from here on can take in full before size runs out
    rounds = F.floor((F.lit(size) - before) / still)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the slice at which rounds run out: the first that has more than its rounds
    marked = counts.withColumn("rounds", rounds).withColumn("place", F.row_number().over(by_count))
    ends = F.min_by(F.when(F.col("eligible_count") > F.col("rounds"), F.col("rounds")), F.when(F.col("eligible_count") > F.col("rounds"), F.col("place"))).over(everything)
    full = marked.withColumn("full", F.coalesce(ends, F.col("eligible_count")))
    taken = full.withColumn("base", F.least("eligible_count", "full"))
    left = F.lit(size) - F.sum("base").over(everything)
    turn = F.row_number().over(Window.partitionBy(F.col("eligible_count") > F.col("base")).orderBy("allocation_key", "cluster_number"))
    extra = (F.col("eligible_count") > F.col("base")) & (turn <= left)
    return taken.withColumn("quota", F.col("base") + extra.cast("long")).select("cluster_number", "allocation_key", "eligible_count", "critical_count", "failure_count", "quota")


def select_sample(candidates: DataFrame, size: int) -> DataFrame:
    """The sample: in each slice, by (tier, key, trace), as many as its quota; selection_rank counts from 1.

    Raises SamplingError where fewer rows are eligible than asked for.
    """
    if candidates.count() < size:
        raise SamplingError(f"size {size} is more than the eligible traces")
    rank = F.row_number().over(Window.partitionBy("cluster_number").orderBy("preference_tier", "selection_key", "trace_id"))
    first = candidates.withColumn("selection_rank", rank).filter(F.col("selection_rank") <= size)  # no slice has a larger quota: the window stops there
    ranked = first.join(F.broadcast(quotas(candidates, size).select("cluster_number", "quota")), "cluster_number")
    return ranked.filter(F.col("selection_rank") <= F.col("quota"))


def build_manifest(candidates: DataFrame, size: int, labels: DataFrame) -> DataFrame:
    """A row for each slice, those with quota 0 too, with the digest of its preferences.

    labels: cluster_number, label, label_key.
    """
    record = fixed_object(
        critical_priority_signal=json_bool(F.col("critical_priority_signal")),
        preference_tier=F.col("preference_tier").cast("string"),
        prior_failure_signal=json_bool(F.col("prior_failure_signal")),
        selection_key=quote(F.col("selection_key")),
        trace_id=quote(F.col("trace_id")),
    )
    preferences = ordered_digests(candidates, F.col("cluster_number"), record, F.col("trace_id")).withColumnsRenamed({"owner": "cluster_number", "digest": "preference_manifest_hash"})
    rows = labels.join(quotas(candidates, size), "cluster_number", "left").join(preferences, "cluster_number", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "cluster_number",
        F.concat(F.lit("cluster-"), F.col("cluster_number").cast("string")).alias("selector"),
        F.col("label").alias("label_snapshot"),
        F.col("label_key").alias("label_key_snapshot"),
        "allocation_key",
        *map(zero, ("eligible_count", "critical_count", "failure_count", "quota")),
        F.coalesce("preference_manifest_hash", sha256(F.lit("[]"))).alias("preference_manifest_hash"),
    )


def build_cases(sample: DataFrame, overrides: DataFrame, dataset: str) -> DataFrame:
    """Evaluation cases of a sample; overrides: source_trace_id, mode, rubric, scorers, priority, review_status.

    Without an override a case is a reference case of medium priority, in draft. Response and
    answer stay in reference cases alone, so that nothing leaks into the prompts of others.
    """
    rows = sample.join(overrides.withColumnRenamed("source_trace_id", "trace_id"), "trace_id", "left")
    mode = F.coalesce("mode", F.lit("reference"))
    answer = F.when(mode == "reference", F.col("response"))
    return rows.select(
        eval_id(F.lit(dataset), F.col("trace_id")).alias("eval_id"),
        F.lit(dataset).alias("dataset_id"),
        F.col("trace_id").alias("source_trace_id"),
        mode.alias("evaluation_mode"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce("review_status", F.lit("draft")).alias("review_status"),
        F.when(mode == "deterministic", F.col("scorers")).alias("scorers"),
        F.when(mode == "rubric", F.col("rubric")).alias("rubric"),
        answer.alias("reference_answer"),
        answer.alias("source_response"),
        "cluster_number",
        "selection_rank",
        "preference_tier",
    )


def unused_overrides(overrides: DataFrame, sample: DataFrame) -> DataFrame:
    """Overrides of traces that weren't selected: an error listing their ids."""
    return overrides.select("source_trace_id").join(sample.select(F.col("trace_id").alias("source_trace_id")), "source_trace_id", "left_anti").orderBy("source_trace_id")
