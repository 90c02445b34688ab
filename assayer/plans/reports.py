"""Inspection of an experiment: details, overview, review queue, filters, slices and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import casefold


def detail(cases: DataFrame, results: DataFrame, comparisons: DataFrame) -> DataFrame:
    """A wide row for each case: both roles' outputs, scores and verdicts beside the comparison.

    cases: eval_id, priority, evaluation_mode, cluster_number, label and texts. results: role,
    eval_id, output, score, passed and what judging adds. A missing role leaves nulls.
    """
    judged = [c for c in ("confidence", "review_status", "review_reasons", "latency_ms") if c in results.columns]
    columns = ["output", "score", "passed", *judged]
    sides = results.groupBy("eval_id").agg(*[F.first(F.when(F.col("role") == r, F.col(c)), ignorenulls=True).alias(f"{r}_{c}") for r in ("baseline", "candidate") for c in columns])
    moved = comparisons.select("eval_id", "score_delta", "transition")
    return cases.join(sides, "eval_id", "left").join(moved, "eval_id", "left")


def slice_label(label: Column, selector: Column) -> Column:
    return F.coalesce(label, selector, F.lit("Unassigned"))


def overview(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """One row of summary values; a critical regression is a newly failed case of critical priority."""
    failed = F.col("transition") == "newly_failed"
    needs = F.col("candidate_review_status") == "needs_review" if "candidate_review_status" in rows.columns else F.lit(False)
    counts = rows.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("transition") == "newly_passed").alias("newly_passed_count"),
        F.count_if(failed).alias("newly_failed_count"),
        F.count_if(failed & (F.col("priority") == "critical")).alias("critical_regression_count"),
        F.count_if(needs).alias("review_count"),
    )
    return counts.crossJoin(violations.agg(F.count("*").alias("gate_violation_count")))  # one row by one row


def filter_cases(rows: DataFrame, slice_label: str | None = None, priority: str | None = None, evaluation_mode: str | None = None, transition: str | None = None, review_state: str | None = None, search: str = "", newly_failed_only: bool = False) -> DataFrame:
    """rows that meet every filter given; search looks into id, prompt and outputs without regard to case."""
    tests = {"slice_label": slice_label, "priority": priority, "evaluation_mode": evaluation_mode, "transition": transition, "candidate_review_status": review_state}
    for column, wanted in tests.items():
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if newly_failed_only:
        rows = rows.filter(F.col("transition") == "newly_failed")
    if needle := search.strip().casefold():
        texts = [c for c in ("eval_id", "source_trace_id", "prompt", "baseline_output", "candidate_output") if c in rows.columns]
        rows = rows.filter(casefold(F.concat_ws(" ", *texts)).contains(needle))
    return rows


def review_queue(rows: DataFrame) -> DataFrame:
    """Cases whose candidate needs review: critical ones first, then by id."""
    queue = rows.filter(F.col("candidate_review_status") == "needs_review")
    first = F.when(F.col("priority") == "critical", 0).otherwise(1)
    return queue.withColumn("queue_group", first).orderBy("queue_group", "eval_id")


def slice_table(slices: DataFrame, limits: list[str], violations: DataFrame) -> DataFrame:
    """Slices by number with gate_status: FAIL, PASS, or Not configured; limits: selectors or labels that have one."""
    broken = violations.select(F.col("scope").alias("selector")).distinct().withColumn("broken", F.lit(True))
    configured = F.col("selector").isin(limits) | F.coalesce(F.col("label_snapshot").isin(limits), F.lit(False)) if limits else F.lit(False)
    status = F.when(F.col("broken"), "FAIL").when(configured, "PASS").otherwise("Not configured")
    rows = slices.join(broken, "selector", "left").withColumn("gate_status", status).drop("broken")
    return rows.withColumn("label", F.coalesce("label_snapshot", "selector")).orderBy("cluster_number", "selector")


def latency(results: DataFrame, fixture_roles: list[str] | None = None, completed: bool = True) -> DataFrame:
    """One row: means by role and their difference, or why there are none.

    Observations count when finite and positive; both roles need two. Fixture providers and
    unfinished runs have no latency.
    """
    number = F.col("latency_ms").cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    mean = lambda r: F.avg(F.when((F.col("role") == r) & good, number))
    count = lambda r: F.count_if((F.col("role") == r) & good)
    rows = results.agg(mean("baseline").alias("b"), mean("candidate").alias("c"), count("baseline").alias("baseline_observations"), count("candidate").alias("candidate_observations"))
    enough = (F.col("baseline_observations") >= 2) & (F.col("candidate_observations") >= 2)
    why = "fixture providers" if fixture_roles else "unfinished runs" if not completed else None
    available = F.lit(why is None) & enough
    message = F.lit(f"Unavailable: {why}") if why else F.when(enough, "Observed provider latency").otherwise("Unavailable: too few observations")
    return rows.select(
        available.alias("available"), message.alias("message"), "baseline_observations", "candidate_observations",
        F.when(available, F.col("b")).alias("baseline_mean_ms"), F.when(available, F.col("c")).alias("candidate_mean_ms"), F.when(available, F.col("c") - F.col("b")).alias("delta_ms"),
    )
