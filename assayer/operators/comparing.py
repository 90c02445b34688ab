"""Runs, their comparison and the regression gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.numbers import count_if, exact_mean
from assayer.functions.ordering import document_index

ROLES = ("baseline", "candidate")
TRANSITIONS = ("passed_both", "failed_both", "newly_passed", "newly_failed")


class ComparisonError(ValueError):
    """Runs that can't be compared."""


def _scope(mode: str) -> Column:
    return F.when(F.grouping(mode) == 1, F.lit("global")).otherwise(F.col(mode))


def _scope_order(scope: Column) -> Column:
    return F.when(scope == "global", F.lit("")).otherwise(scope)


def run_aggregates(results: DataFrame) -> DataFrame:
    """(role, scope, case_count, passed, failed, score, pass_rate): global and each mode that occurs.

    One pass: both grouping sets come from one Expand, summed before the shuffle.
    """
    passed = count_if(F.col("passed"))
    sets = results.groupingSets([["role"], ["role", "evaluation_mode"]], "role", "evaluation_mode")
    return sets.agg(
        _scope("evaluation_mode").alias("scope"),
        F.count("*").alias("case_count"),
        passed.alias("passed_count"),
        (F.count("*") - passed).alias("failed_count"),
        exact_mean(F.col("score")).alias("score"),
        (passed / F.count("*")).alias("pass_rate"),
    ).drop("evaluation_mode")


def run_slice_aggregates(results: DataFrame, membership: DataFrame) -> DataFrame:
    """The same by slice; membership: eval_id, cluster_number, selector, label_snapshot. Cases outside slices don't count."""
    passed = count_if(F.col("passed"))
    rows = results.join(membership.select("eval_id", "cluster_number", "selector", "label_snapshot"), "eval_id")
    return rows.groupBy("role", "cluster_number", "selector", "label_snapshot").agg(
        F.count("*").alias("case_count"),
        passed.alias("passed_count"),
        (F.count("*") - passed).alias("failed_count"),
        exact_mean(F.col("score")).alias("score"),
        (passed / F.count("*")).alias("pass_rate"),
    )


def transition(before: Column, after: Column) -> Column:
    return F.when(before & after, "passed_both").when(~before & ~after, "failed_both").when(after, "newly_passed").otherwise("newly_failed")


def coverage_gaps(results: DataFrame) -> DataFrame:
    """Cases that only one role has, or whose mode differs: none before runs can be compared."""
    b, c = (results.filter(F.col("role") == r).select("eval_id", F.col("evaluation_mode").alias(f"{r}_mode"), F.lit(True).alias(r)) for r in ROLES)
    both = b.join(c, "eval_id", "full_outer")
    return both.filter(F.col("baseline").isNull() | F.col("candidate").isNull() | (F.col("baseline_mode") != F.col("candidate_mode")))


def compare_cases(results: DataFrame) -> DataFrame:
    """(eval_id, evaluation_mode, baseline and candidate score and verdict, score_delta, transition).

    One aggregation over both roles instead of a self-join: the rows of a case meet in one shuffle.
    """
    value = lambda c, r: F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}")
    wide = results.groupBy("eval_id").agg(F.max("evaluation_mode").alias("evaluation_mode"), *[value(c, r) for r in ROLES for c in ("score", "passed")])
    wide = wide.filter(F.col("baseline_passed").isNotNull() & F.col("candidate_passed").isNotNull())
    return wide.withColumn("score_delta", F.col("candidate_score") - F.col("baseline_score")).withColumn("transition", transition(F.col("baseline_passed"), F.col("candidate_passed")))


def _comparison_measures() -> list[Column]:
    before, after = exact_mean(F.col("baseline_score")), exact_mean(F.col("candidate_score"))
    return [
        F.count("*").alias("case_count"),
        before.alias("baseline_score"),
        after.alias("candidate_score"),
        (after - before).alias("score_delta"),  # of the means
        count_if(F.col("transition") == "newly_passed").alias("newly_passed_count"),
        count_if(F.col("transition") == "newly_failed").alias("newly_failed_count"),
    ]


def comparison_aggregates(cases: DataFrame) -> DataFrame:
    """By scope: means of both roles, their difference, and cases newly passed and failed."""
    return cases.groupingSets([[], ["evaluation_mode"]], "evaluation_mode").agg(_scope("evaluation_mode").alias("scope"), *_comparison_measures()).drop("evaluation_mode").filter("case_count > 0")


def comparison_slices(cases: DataFrame, membership: DataFrame) -> DataFrame:
    """By slice, with pass rates of both roles and the ids newly passed and failed, in order."""
    rows = cases.join(membership.select("eval_id", "cluster_number", "selector", "label_snapshot"), "eval_id")
    ids = lambda t: F.sort_array(F.collect_list(F.when(F.col("transition") == t, F.col("eval_id")))).alias(t)
    rate = lambda r: (count_if(F.col(f"{r}_passed")) / F.count("*")).alias(f"{r}_pass_rate")
    return rows.groupBy("cluster_number", "selector", "label_snapshot").agg(*_comparison_measures(), *map(rate, ROLES), ids("newly_passed"), ids("newly_failed"))


def newly_lists(cases: DataFrame) -> DataFrame:
    """(transition, ordinal, eval_id): the report's lists of newly passed and newly failed cases, a row for each case.

    A list of any length is in order, its places counted from 0 by sorted ranges; no task holds one whole.
    """
    moved = cases.filter(F.col("transition").isin("newly_passed", "newly_failed")).select("transition", "eval_id")
    placed = document_index(moved.withColumn("_key", F.concat("transition", F.lit(" "), "eval_id")), "_key")
    first = placed.groupBy("transition").agg(F.min("document_index").alias("_first"))  # two rows
    return placed.join(F.broadcast(first), "transition").select("transition", (F.col("document_index") - F.col("_first")).alias("ordinal"), "eval_id")


@dataclass(frozen=True)
class Limits:
    """Allowed score drop and newly failed cases; None falls back to the global limit."""

    max_score_drop: float | None = None
    max_new_failures: int | None = None


def effective_limits(overall: Limits, by_mode: dict[str, Limits]) -> dict[str, Limits]:
    """Limits by scope, global first, then modes in order; each field falls back by itself."""
    drop = 0.0 if overall.max_score_drop is None else overall.max_score_drop
    failures = 0 if overall.max_new_failures is None else overall.max_new_failures
    out = {"global": Limits(drop, failures)}
    for mode in sorted(by_mode):
        own = by_mode[mode]
        out[mode] = Limits(drop if own.max_score_drop is None else own.max_score_drop, failures if own.max_new_failures is None else own.max_new_failures)
    return out


def resolve_selector(selector: str, slices: list[tuple[int, str | None]]) -> int:
    """The cluster that a selector names: cluster-N, or a label by its key. slices: (number, label)."""
    from assayer.functions.text import label_key_of

    key = label_key_of(selector)
    hits = {n for n, label in slices if selector.strip() == f"cluster-{n}" or (label is not None and label_key_of(label) == key)}
    if not hits:
        raise ComparisonError(f"slice {selector!r} has no cases in the dataset")
    if len(hits) > 1:
        raise ComparisonError(f"slice {selector!r} is ambiguous: " + ", ".join(f"cluster-{n}" for n in sorted(hits)))
    return hits.pop()


def slice_limits(by_slice: dict[str, Limits], slices: list[tuple[int, str | None]]) -> dict[int, Limits]:
    """Limits by cluster number; missing fields are 0. Two selectors of one slice are an error."""
    out: dict[int, Limits] = {}
    for selector, own in by_slice.items():
        number = resolve_selector(selector, slices)
        if number in out:
            raise ComparisonError(f"cluster-{number} has several limits")
        out[number] = Limits(own.max_score_drop or 0.0, own.max_new_failures or 0)
    return out


def gate_violations(aggregates: DataFrame, limits: dict[str, Limits], slices: DataFrame | None = None, by_slice: dict[int, Limits] | None = None) -> DataFrame:
    """A row for each limit that is exceeded (reaching it is allowed), numbered in order.

    Order: global, modes by name, slices by number; score_drop before new_failures. Limits are a
    handful of rows, so they travel as literals; the aggregates have a row for each scope.
    """
    spark, kind = aggregates.sparkSession, "scope string, cluster_number int, max_drop double, max_failures long, place int"
    listed = [(s, None, float(v.max_score_drop), int(v.max_new_failures), i) for i, (s, v) in enumerate(limits.items())]
    listed += [(f"cluster-{n}", n, float(v.max_score_drop), int(v.max_new_failures), len(limits) + i) for i, (n, v) in enumerate(sorted((by_slice or {}).items()))]
    wanted = spark.createDataFrame(listed, kind)
    measures = ["score_delta", "newly_failed_count"]
    rows = aggregates.select("scope", F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("label_snapshot"), *measures)
    if slices is not None:
        rows = rows.unionByName(slices.select(F.col("selector").alias("scope"), F.col("cluster_number").cast("int").alias("n"), "label_snapshot", *measures))
    sliced = slices is not None
    met = rows.join(F.broadcast(wanted.withColumnRenamed("scope", "w_scope")), (F.col("n").eqNullSafe(F.col("cluster_number"))) & (F.col("scope") == F.col("w_scope")))
    drop = F.greatest(F.lit(0.0), -F.col("score_delta"))
    failed = F.col("newly_failed_count")
    checks = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("score_drop").alias("metric"), drop.alias("actual"), F.col("max_drop").alias("allowed"), F.format_string("%s score drop %.6f exceeds %.6f", "scope", drop, "max_drop").alias("message")),
        F.struct(F.lit(1).alias("k"), F.lit("new_failures").alias("metric"), failed.cast("double").alias("actual"), F.col("max_failures").cast("double").alias("allowed"), F.format_string("%s newly failed count %d exceeds %d", "scope", failed, "max_failures").alias("message")),
    )
    found = met.select("scope", "n", "label_snapshot", "place", F.explode(checks).alias("c")).filter("c.actual > c.allowed")
    kind_of = F.when(F.lit(not sliced), F.lit(None).cast("string")).when(F.col("n").isNotNull(), "slice").when(F.col("scope") == "global", "global").otherwise("mode")
    index = F.row_number().over(Window.orderBy("place", "c.k")) - 1  # a few rows, however many cases
    return found.select(index.alias("violation_index"), "scope", kind_of.alias("scope_kind"), F.col("n").alias("cluster_number"), "label_snapshot", "c.metric", "c.actual", "c.allowed", "c.message")


def verdict(violations: DataFrame) -> DataFrame:
    """PASS where there is no violation, else FAIL."""
    return violations.agg(F.count("*").alias("violation_count")).withColumn("verdict", F.when(F.col("violation_count") == 0, "PASS").otherwise("FAIL"))
