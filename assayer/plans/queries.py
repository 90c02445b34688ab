"""The evaluation queries over the driver's tables, with equivalent SQL for DuckDB.

Traces come from conversations: a user turn and the assistant turn after it. Cases are traces with
a response; modes, priorities and slices are dealt by arithmetic on the ids, and each role's output
is the response or, for some ids, a wrong one. Where ids decide which
rows are there, they stand for outputs that a provider left out; no query leaves rows out to be
cheap. The SQL repeats the rules, not the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.ids import eval_id, sha256
from assayer.functions.json_text import fixed_object, quote
from assayer.functions.numbers import exact_mean
from assayer.functions.ordering import ordered_digest, ordered_digests
from assayer.functions.text import nonblank, strip
from assayer.operators import clustering, comparing, judging, sampling, scoring
from assayer.plans import constraints, reports

CONFIG_HASH, MANIFEST_HASH = "c" * 64, "d" * 64
SAMPLE_SIZE = 20
RESTARTS = 20
DATASET = "dataset_0123456789abcdef0123456789abcdef"
LIMITS = {"global": comparing.Limits(0.01, 5), "deterministic": comparing.Limits(0.0, 3), "reference": comparing.Limits(1.0, 1000), "rubric": comparing.Limits(0.02, 1)}
SLICE_LIMITS = {0: comparing.Limits(0.0, 0), 3: comparing.Limits(0.05, 2), 5: comparing.Limits(1.0, 1000)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("trace_id")
    return user.join(answer, ["conv_id", "turn"], "left").select(name, "conv_id", "turn", "prompt", "response")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, scoring.MODES)), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    priority = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "medium", "low"))), (F.col("conv_id") % 5 + 1).cast("int"))
    rows = traces(spark, sf_dir).filter(nonblank(F.col("response")))
    cluster = (F.col("conv_id") % 7).cast("int")
    return rows.select(
        F.concat(F.lit("e-"), "trace_id").alias("eval_id"), F.col("trace_id").alias("source_trace_id"), "conv_id", "turn", "prompt", "response",
        mode.alias("evaluation_mode"), priority.alias("priority"), cluster.alias("cluster_number"),
        F.concat(F.lit("cluster-"), cluster).alias("selector"), F.when(cluster % 2 == 0, F.concat(F.lit("label "), cluster)).alias("label_snapshot"),
    )


def outputs(rows: DataFrame) -> DataFrame:
    wrong = {"baseline": (F.col("conv_id") * 7 + F.col("turn")) % 5 == 0, "candidate": (F.col("conv_id") * 11 + F.col("turn")) % 6 == 0}
    both = F.array(*[F.struct(F.lit(r).alias("role"), F.when(w, "wrong").otherwise(F.col("response")).alias("output")) for r, w in wrong.items()])
    return rows.select("*", F.explode(both).alias("o")).select("*", "o.*").drop("o")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, eval_id, evaluation_mode, output, score, passed, ...): exact matches; rubric scores come from the ids."""
    rows = outputs(cases(spark, sf_dir))
    rubric = F.col("evaluation_mode") == "rubric"
    same = F.col("output") == F.col("response")
    judged = ((F.col("conv_id") * 3 + F.col("turn") + F.when(F.col("role") == "baseline", 0).otherwise(2)) % 5) / F.lit(4.0)
    return rows.withColumn("score", F.when(rubric, judged).otherwise(same.cast("double"))).withColumn("passed", F.col("score") >= 0.5)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- sources and first-wins deduplication ---------------------------------------------------


def all_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, newest first, ties by id."""
    rows = table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "event_type")


def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """positions in the order of trace_id."""
    return clustering.document_index(traces(spark, sf_dir).select("trace_id")).select("trace_id", F.col("document_index").cast("long").alias("document_index"))


# --- scorers ---------------------------------------------------------------------------------


def score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    rows = outputs(cases(spark, sf_dir)).filter("evaluation_mode = 'reference'")
    return rows.select("role", "eval_id", scoring.exact_match(F.col("output"), F.col("response")).alias("passed"))


def score_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without regard to case."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", scoring.contains(F.col("html"), "<Title>").alias("exact"), scoring.contains(F.col("html"), "<Title>", False).alias("folded"))


def score_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return table(spark, sf_dir, "pages").select("page_id", scoring.regex(F.col("url"), r"https?://[a-z0-9.\-]+/[a-z]+").alias("passed"))


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 10 == 1, F.lit("{not json")).when(F.col("event_id") % 10 == 2, F.concat(F.lit("["), "props", F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(broken, F.col("props")).alias("output"))


def score_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    return _props(spark, sf_dir).select("event_id", scoring.json_validity(F.col("output")).alias("passed"))


def score_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return _props(spark, sf_dir).select("event_id", scoring.required_keys(F.col("output"), ["k"]).alias("passed"))


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's own scorers; a deterministic case has two, a reference case its answer."""
    rows = cases(spark, sf_dir)
    config = lambda name, **f: F.struct(F.lit(name).alias("name"), fixed_object(**f).alias("config"))
    own = F.array(config("exact_match", expected=quote(F.col("response"))), config("contains", substring=F.lit('"e"')))
    listed = rows.select("eval_id", "evaluation_mode", F.col("response").alias("reference_answer"), F.when(F.col("evaluation_mode") == "deterministic", own).alias("scorers"))
    scored = scoring.score_cases(listed, outputs(rows).select("role", "eval_id", "output"))
    return _rounded(scored.select("role", "eval_id", "evaluation_mode", "score", "passed"), "score")


# --- runs, comparison, gate --------------------------------------------------------------------


def run_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    return _rounded(comparing.run_aggregates(results(spark, sf_dir)), "score", "pass_rate")


def run_slice_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12, E3."""
    members = cases(spark, sf_dir).filter("cluster_number != 6")
    return _rounded(comparing.run_slice_aggregates(results(spark, sf_dir).select("role", "eval_id", "evaluation_mode", "score", "passed"), members), "score", "pass_rate")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.compare_cases(results(spark, sf_dir).select("role", "eval_id", "evaluation_mode", "score", "passed"))


def case_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10, G7, I23."""
    return _compared(spark, sf_dir)


def comparison_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    return _rounded(comparing.comparison_aggregates(_compared(spark, sf_dir)), "baseline_score", "candidate_score", "score_delta")


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.comparison_slices(_compared(spark, sf_dir), cases(spark, sf_dir).filter("cluster_number != 6"))


def comparison_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11, E5."""
    rows = _rounded(_slices(spark, sf_dir), "baseline_score", "candidate_score", "score_delta", "baseline_pass_rate", "candidate_pass_rate")
    return rows.withColumns({c: F.array_join(c, ",") for c in ("newly_passed", "newly_failed")})


def newly_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly passed and newly failed cases with their places in the report's lists."""
    return comparing.newly_lists(_compared(spark, sf_dir))


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.gate_violations(comparing.comparison_aggregates(_compared(spark, sf_dir)), LIMITS, _slices(spark, sf_dir), SLICE_LIMITS)


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, G2, J16, J18."""
    return _rounded(_violations(spark, sf_dir), "actual", "allowed")


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return comparing.verdict(_violations(spark, sf_dir))


def gate_over_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, J16 over orders: items not returned against items billed, by order priority."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("b"), F.count_if((F.col("l_linestatus") == "O") | (F.col("l_quantity") > 25)).alias("c"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    score = lambda c: F.round(F.col(c) / F.col("n"), 6)
    wide = rows.select(F.col("o_orderpriority").alias("evaluation_mode"), score("b").alias("baseline_score"), score("c").alias("candidate_score"))
    wide = wide.withColumn("transition", comparing.transition(F.col("baseline_score") >= 0.5, F.col("candidate_score") >= 0.5))
    limits = {"global": comparing.Limits(0.01, 10), "1-URGENT": comparing.Limits(0.0, 0)}
    return _rounded(comparing.gate_violations(comparing.comparison_aggregates(wide), limits), "actual", "allowed")


# --- judging -------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two criteria for each labelled document: its quality, and that it isn't toxic."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("double").alias("s1"), (1 - F.col("toxic")).cast("double").alias("s2"), (F.col("n_chars") % 100 / F.lit(100.0)).alias("confidence"), F.when(F.col("doc_id") % 4 == 0, "critical").otherwise("high").alias("priority"))


def judge_criteria_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean and the verdict of all criteria, through the response validator."""
    rows = _judged(spark, sf_dir)
    criterion = lambda n, c: F.concat(F.lit(f'{{"criterion":"{n}","passed":'), (F.col(c) >= 0.5).cast("string"), F.lit(',"reason":"r","score":'), F.col(c).cast("string"), F.lit("}"))
    overall = F.when(F.col("doc_id") % 9 == 0, F.lit(0.123)).otherwise((F.col("s1") + F.col("s2")) / 2)
    whole = F.concat(F.lit('{"schema_version":1,"confidence":0.9,"overall_score":'), overall.cast("string"), F.lit(',"overall_passed":'), ((F.col("s1") >= 0.5) & (F.col("s2") >= 0.5)).cast("string"), F.lit(',"criteria":['), criterion("good", "s1"), F.lit(","), criterion("clean", "s2"), F.lit("]}"))
    judged = rows.select("doc_id", judging.judge_outputs(F.array(whole), F.array(F.lit("good"), F.lit("clean"))).alias("j"))
    return judged.select("doc_id", "j.code", "j.score", "j.passed")


def judge_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low confidence, then critical failures."""
    rows = _judged(spark, sf_dir).withColumn("passed", (F.col("s1") >= 0.5) & (F.col("s2") >= 0.5))
    out = judging.with_review(rows, 0.7)
    return out.select("doc_id", "below_threshold", "review_status", F.array_join("review_reasons", ",").alias("review_reasons"))


def judge_cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of texts, the cache holding those of even ids."""
    key = judging.cache_key(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))
    cache = docs.filter("doc_id % 2 = 0").groupBy("cache_key").agg(F.min("doc_id").cast("string").alias("raw_response"))
    return judging.look_up(docs, cache).groupBy("cache_status").agg(F.count("*").alias("n"), F.min("cache_key").alias("least_key"))


# --- sampling ------------------------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    scored = results(spark, sf_dir).select("eval_id", "passed", F.concat(F.lit("run-"), "role").alias("run_id"))
    runs = spark.createDataFrame([("run-baseline", "x1", "completed"), ("run-candidate", "x1", "failed")], "run_id string, experiment_id string, status string")
    return sampling.history_signals(rows, scored, runs, spark.createDataFrame([("x1", "completed")], "experiment_id string, status string"))


def historical_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, H6, J20."""
    return _signals(spark, sf_dir)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = traces(spark, sf_dir).select("trace_id", (F.col("conv_id") % 7).cast("int").alias("cluster_number"), "response", sha256(F.col("prompt")).alias("document_hash"), sha256(F.col("trace_id")).alias("source_trace_hash"))
    return sampling.eligible(assigned, _signals(spark, sf_dir), CONFIG_HASH, MANIFEST_HASH)


def eligible_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, C10, E9, I24."""
    rows = _candidates(spark, sf_dir).groupBy("cluster_number")
    return rows.agg(F.count("*").alias("eligible_count"), F.count_if("critical_priority_signal").alias("critical_count"), F.count_if("prior_failure_signal").alias("failure_count"))


def sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return sampling.quotas(_candidates(spark, sf_dir), SAMPLE_SIZE)


def sample_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, G4, I6, I24, I25, J21."""
    rows = sampling.select_sample(_candidates(spark, sf_dir), SAMPLE_SIZE)
    return rows.select("trace_id", "cluster_number", "preference_tier", "selection_key", "selection_rank")


def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each conversation's records, in order."""
    record = fixed_object(document_hash=quote(sha256(F.col("prompt"))), trace_id=quote(F.col("trace_id")))
    found = ordered_digests(traces(spark, sf_dir), F.col("conv_id"), record, F.col("trace_id"))
    return found.withColumnsRenamed({"owner": "conv_id", "digest": "manifest_hash"})


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all traces, and one over all events, in order; no task holds either list."""
    hashed = traces(spark, sf_dir).select("trace_id", sha256(F.col("prompt")).alias("document_hash"), sha256(F.coalesce("response", F.lit(""))).alias("source_trace_hash"))
    record = fixed_object(event=F.col("event_id").cast("string"), type=quote(F.col("event_type")))
    events = ordered_digest(table(spark, sf_dir, "events"), record, F.col("event_id"))
    rows = [("events", events), ("traces", clustering.source_manifest(hashed))]
    return spark.createDataFrame(rows, "source string, manifest_hash string")


def eval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11, I12."""
    return traces(spark, sf_dir).select("trace_id", eval_id(F.lit(DATASET), F.col("trace_id")).alias("eval_id"))


# --- clustering ----------------------------------------------------------------------------------


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2 over the benchmark's items."""
    return _rounded(clustering.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text"), "weight").withColumnRenamed("id", "item_id")


def tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: rows have norm 1."""
    weights = clustering.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return weights.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("terms"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


def trace_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2 over the documents of all traces."""
    return _rounded(clustering.tfidf(_trace_documents(spark, sf_dir), "trace_id", "document"), "weight").withColumnRenamed("id", "trace_id")


def trace_distinct_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of traces differ in their weights."""
    n = clustering.distinct_vectors(clustering.tfidf(_trace_documents(spark, sf_dir), "trace_id", "document"))
    return spark.range(1).select(F.lit(n).cast("long").alias("distinct_vectors"))


def cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels of the vectors renumbered by their least member."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return clustering.canonical_numbers(rows, "cluster", "vec_id").select("vec_id", "cluster_number")


def kmeans_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: ten clusters of the vectors, canonically numbered."""
    rows = clustering.stored_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")))
    made = clustering.kmeans(rows, 10, RESTARTS)[0].withColumnRenamed("id", "vec_id")
    return clustering.canonical_numbers(made, "cluster", "vec_id").select("vec_id", "cluster_number")


# --- catalogues, reports, constraints --------------------------------------------------------------


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = results(spark, sf_dir).select("role", "eval_id", "evaluation_mode", "output", "score", "passed", F.when((F.col("evaluation_mode") == "rubric") & (F.col("conv_id") % 3 == 0), "needs_review").otherwise("not_required").alias("review_status"))
    rows = cases(spark, sf_dir).withColumn("slice_label", reports.slice_label(F.col("label_snapshot"), F.col("selector")))
    return reports.detail(rows, scored, comparing.compare_cases(scored))


def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15, J29, J31."""
    return _detail(spark, sf_dir).select("eval_id", "slice_label", "priority", "baseline_output", "candidate_output", "baseline_passed", "candidate_passed", "score_delta", "transition")


def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13."""
    return reports.overview(_detail(spark, sf_dir), _violations(spark, sf_dir))


def filter_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    return reports.filter_cases(_detail(spark, sf_dir), priority="medium", evaluation_mode="reference", search=" WRONG ").select("eval_id", "transition")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return reports.review_queue(_detail(spark, sf_dir)).select("queue_group", "eval_id", "priority")


def slice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, J30."""
    rows = reports.slice_table(_slices(spark, sf_dir), [f"cluster-{n}" for n in SLICE_LIMITS], _violations(spark, sf_dir))
    return rows.select("cluster_number", "label", "case_count", "gate_status")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two kinds as the roles' observations."""
    rows = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    seen = rows.select(F.when(F.col("event_type") == "view", "baseline").otherwise("candidate").alias("role"), (F.round("value", 2) - 1).alias("latency_ms"))
    return _rounded(reports.latency(seen), "baseline_mean_ms", "candidate_mean_ms", "delta_ms")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of parts that cost less than the store holds."""
    parts = table(spark, sf_dir, "part").filter("p_size < 40")
    return constraints.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey", "p_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


def mode_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose columns don't fit their mode."""
    rows = cases(spark, sf_dir)
    shaped = rows.select(
        "eval_id", "evaluation_mode",
        F.when(F.col("evaluation_mode") == "deterministic", F.when(F.col("conv_id") % 11 != 0, F.array(F.lit("s")))).alias("scorers"),
        F.when(F.col("evaluation_mode") == "rubric", F.array(F.lit("r"))).alias("rubric"),
        F.when((F.col("evaluation_mode") == "reference") | (F.col("conv_id") % 13 == 0), F.col("response")).alias("reference_answer"),
        F.when(F.col("evaluation_mode") == "reference", F.col("response")).alias("source_response"),
    )
    return shaped.filter(~constraints.case_shape()).select("eval_id", "evaluation_mode")


def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status event of each owner."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("sequence"), F.col("event_type").alias("status"))
    return constraints.current_status(rows, "owner")


def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped whole texts, with white space on both sides, and their hashes."""
    whole = strip(F.concat(F.lit("\t "), "text", F.lit(" \u3000\n")))
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("label"), sha256(whole).alias("label_hash"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13."""
    from assayer.functions.json_text import redact_json

    held = F.concat(F.lit('{"auth_token":"x","nested":[{"API_KEY":1,"k":'), "props", F.lit("}]}"))
    return table(spark, sf_dir, "events").select("event_id", redact_json(held).alias("snapshot"))


def priority_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, I14 as decimals: means of prices by order priority don't depend on order."""
    return _rounded(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(exact_mean(F.round("o_totalprice", 2) / 1000000).alias("mean"), F.count("*").alias("n")), "mean")


# --- integrity of stored rows, scalar functions -------------------------------------------------------


def provenance_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance that isn't its source's, nulls being equal."""
    source = cases(spark, sf_dir).select("eval_id", "label_snapshot", "cluster_number")
    held = source.withColumn("label_snapshot", F.when(F.col("cluster_number") == 3, "label 3").otherwise(F.col("label_snapshot")))
    return constraints.changed_provenance(held, source, "eval_id", ["label_snapshot", "cluster_number"])


def slice_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of all cases against the members that have a label."""
    rows = cases(spark, sf_dir)
    counts = rows.groupBy("cluster_number").agg(F.count("*").alias("case_count"))
    found = constraints.slice_membership(counts, rows.filter("label_snapshot is not null"))
    return found.select("cluster_number", "case_count", F.coalesce("members", F.lit(0)).alias("members"))


def violation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of scopes that only labeled slices and one mode could have."""
    rows = cases(spark, sf_dir)
    bad = constraints.violation_scopes(_violations(spark, sf_dir), rows.filter("evaluation_mode = 'rubric'").select("evaluation_mode"), rows.filter("label_snapshot is not null").select("selector"))
    return bad.select("scope", "scope_kind", "metric")


def foreign_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of cases that another dataset holds."""
    mine = cases(spark, sf_dir).filter("priority != 'low'")
    return constraints.foreign_results(results(spark, sf_dir).select("role", "eval_id", "evaluation_mode"), mine)


def judge_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge results against lookups and cache."""
    rows = _judged(spark, sf_dir).withColumn("passed", (F.col("s1") >= 0.5) & (F.col("s2") >= 0.5))
    rows = judging.with_review(rows, 0.7).select(F.lit("r").alias("run_id"), F.col("doc_id").cast("string").alias("eval_id"), "priority", "passed", "review_reasons", "doc_id")
    lookups = rows.filter("doc_id % 10 != 3").select("run_id", "eval_id", F.concat(F.lit("k"), F.col("doc_id") % 50).alias("cache_key"), F.when(F.col("doc_id") % 2 == 0, "hit").otherwise("miss").alias("cache_status"))
    return constraints.judge_mismatches(rows, lookups, lookups.filter("cache_key != 'k4'")).select("eval_id")


def assignment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as assignments of a run for each label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clustering_run_id"), (F.col("vec_id") % 7).cast("int").alias("cluster_number"), F.col("vec_id").alias("document_index"))
    runs = rows.groupBy("clustering_run_id").agg((F.max("document_index") + 1).alias("trace_count"), (6 + F.max(F.col("clustering_run_id").cast("int")) % 2).alias("cluster_count"))
    return constraints.assignment_faults(rows, runs).select("clustering_run_id", "outside")


def mode_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes present, the cases of each."""
    return cases(spark, sf_dir).groupBy("evaluation_mode").agg(F.count("*").alias("n"), F.min("eval_id").alias("first"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a report's runs, baseline first."""
    runs = {"baseline": "run-baseline", "candidate": "run-candidate"}
    rows = results(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run-"), "role")).filter(F.col("run_id").isin(*runs.values()))
    return rows.select(F.when(F.col("role") == "baseline", 0).otherwise(1).alias("role_order"), "run_id", "eval_id", "score").orderBy("role_order", "eval_id")


def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: cases that only one of two runs has."""
    rows = results(spark, sf_dir).filter("not (role = 'candidate' and priority = 'high')").select("role", "eval_id", "evaluation_mode")
    return comparing.coverage_gaps(rows).select("eval_id", F.coalesce("baseline", F.lit(False)).alias("baseline"), F.coalesce("candidate", F.lit(False)).alias("candidate"))


def judge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by role of the labelled documents as judgments."""
    rows = _judged(spark, sf_dir).withColumn("passed", (F.col("s1") >= 0.5) & (F.col("s2") >= 0.5)).withColumn("role", F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("candidate"))
    return judging.counters(judging.with_review(rows, 0.7).withColumn("cache_status", F.when(F.col("doc_id") % 3 == 0, "hit").otherwise("miss")))


def critical_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with a critical case that failed in some role, once each."""
    return results(spark, sf_dir).filter("priority = 'critical' and not passed").select("source_trace_id").distinct()


def build_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each slice, empty ones too."""
    labels = spark.range(9).select(F.col("id").cast("int").alias("cluster_number"), F.concat(F.lit("label "), "id").alias("label"), F.concat(F.lit("label "), "id").alias("label_key"))
    return sampling.build_manifest(_candidates(spark, sf_dir), SAMPLE_SIZE, labels)


def built_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the sample with overrides of some slices."""
    sample = sampling.select_sample(_candidates(spark, sf_dir), SAMPLE_SIZE)
    overrides = sample.filter("cluster_number in (1, 2)").select(F.col("trace_id").alias("source_trace_id"), F.when(F.col("cluster_number") == 1, "rubric").otherwise("deterministic").alias("mode"), F.array(F.lit("clear")).alias("rubric"), F.array(F.struct(F.lit("json_validity").alias("name"), F.lit("{}").alias("config"))).alias("scorers"), F.lit("high").alias("priority"), F.lit(None).cast("string").alias("review_status"))
    rows = sampling.build_cases(sample, overrides, DATASET)
    return rows.select("eval_id", "source_trace_id", "evaluation_mode", "priority", "review_status", "reference_answer", F.array_join("rubric", ",").alias("rubric"), F.size("scorers").alias("scorers"))


def _trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("turn") % 4 == 1, fixed_object(conv=F.col("conv_id").cast("string"))).otherwise("{}")
    return traces(spark, sf_dir).select("trace_id", clustering.document_text(F.col("prompt"), context).alias("document"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is clustered, and its hash; every second trace has a context."""
    return _trace_documents(spark, sf_dir).select("trace_id", clustering.document_hash(F.col("document")).alias("document_hash"))


def trace_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the canonical records of events as traces."""
    from assayer.sources.traces import payload

    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("task_type"), F.lit("p").alias("prompt"), F.when(F.col("user_id") % 2 == 0, F.lit("r")).alias("response"), F.lit("{}").alias("context_json"), F.lit('{"a":1}').alias("metadata_json"))
    return rows.select("trace_id", sha256(payload(rows)).alias("source_trace_hash"))


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case folding and label keys of whole texts; the SQL folds the tables' letters, not all of Unicode's."""
    from assayer.functions.text import casefold, label_key

    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", casefold(text).alias("folded"), label_key(text).alias("label_key"))


def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the prompts that a judge would get."""
    prompt = judging.request_prompt("Judge.", F.col("prompt"), F.col("response"), F.array(F.lit("clear"), F.lit("kind")), F.lit("{}"))
    return cases(spark, sf_dir).filter("evaluation_mode = 'rubric'").select("eval_id", sha256(prompt).alias("request_hash"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    all_newest_first, document_order,
    score_exact, score_contains, score_regex, score_json_validity, score_required_keys, case_scores,
    run_aggregates, run_slice_aggregates, case_comparisons, comparison_aggregates, comparison_slices, newly_lists, gate_violations, gate_verdict, gate_over_lineitem,
    judge_criteria_scores, judge_review_state, judge_cache_status, historical_signals, eligible_by_slice, sample_quota, sample_selection, manifest_hash, source_manifest, eval_ids,
    tfidf_weights, tfidf_norms, trace_tfidf_weights, trace_distinct_vectors, cluster_numbers, kmeans_slices, detail_join, overview_metrics, filter_cases, review_queue, slice_table,
    latency_summary, orphans, mode_shape, current_status, stripped_texts, redaction, priority_means,
    provenance_mismatch, slice_membership, violation_scopes, foreign_results, judge_mismatches, assignment_faults, mode_partition, run_results, run_coverage, judge_counters, critical_failures,
    build_manifest, built_cases, document_texts, trace_hashes, folded_texts, judge_prompts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from assayer.plans import library

    return {q.__name__: q for q in QUERIES} | library.QUERIES
