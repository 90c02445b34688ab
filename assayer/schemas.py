"""Explicit schemas of all stored tables. Open JSON stays canonical text; times are UTC."""

from __future__ import annotations

from pyspark.sql.types import StructType

SCORERS = "array<struct<name:string,config:string>>"
_SCOPE_RUN = "case_count bigint, passed_count bigint, failed_count bigint, score double, pass_rate double"
_SCOPE_COMPARED = "case_count bigint, baseline_score double, candidate_score double, score_delta double, newly_passed_count bigint, newly_failed_count bigint"

DDL: dict[str, str] = {
    "traces": "trace_id string, timestamp timestamp, task_type string, prompt string, response string, context_json string, metadata_json string",
    "rejects": "file string, line bigint, message string",
    "clustering_runs": "clustering_run_id string, name string, configuration_hash string, source_manifest_hash string, trace_count bigint, cluster_count int, inertia double, created_at timestamp",
    "cluster_assignments": "clustering_run_id string, trace_id string, document_index bigint, cluster_number int, document_hash string, source_trace_hash string",
    "cluster_labels": "clustering_run_id string, cluster_number int, label string, label_key string, version bigint, updated_at timestamp",
    "datasets": "dataset_id string, name string, version string, description string, created_at timestamp",
    "cases": f"eval_id string, dataset_id string, source_trace_id string, evaluation_mode string, priority string, review_status string, task_type string, prompt string, context_json string, scorers {SCORERS}, rubric array<string>, reference_answer string, source_response string",
    "slice_builds": "dataset_id string, clustering_run_id string, sampled_size bigint, manifest_hash string, configuration_hash string, source_manifest_hash string, created_at timestamp",
    "slice_provenance": "eval_id string, dataset_id string, trace_id string, cluster_number int, selector string, label_snapshot string, label_key_snapshot string, preference_tier int, critical_priority_signal boolean, prior_failure_signal boolean, selection_key string, allocation_key string, selection_rank int, document_hash string, source_trace_hash string",
    "experiments": "experiment_id string, name string, dataset_id string, configuration_hash string, created_at timestamp",
    "experiment_events": "experiment_id string, sequence bigint, status string, verdict string, failure_stage string, failure_message string, at timestamp",
    "runs": "run_id string, experiment_id string, role string, provider string, model string, prompt_hash string, settings_json string",
    "run_events": "run_id string, experiment_id string, sequence bigint, status string, failure_message string, at timestamp",
    "judges": "experiment_id string, provider string, model string, confidence_threshold double, prompt_hash string, retry_prompt_hash string",
    "judge_cache": "cache_key string, identity_json string, raw_response string, written_at timestamp",
    "outputs": "run_id string, experiment_id string, role string, eval_id string, output string, latency_ms double, metadata string",
    "requests": "run_id string, experiment_id string, key string, role string, eval_id string, attempt int, event string, at string, error string",
    "judge_answers": "run_id string, experiment_id string, role string, eval_id string, outputs array<string>",
    "case_results": "run_id string, experiment_id string, role string, eval_id string, evaluation_mode string, output string, score double, passed boolean, latency_ms double",
    "judge_attempts": "run_id string, experiment_id string, eval_id string, attempt int, raw_response string, error_code string, error string",
    "judge_lookups": "run_id string, experiment_id string, eval_id string, cache_key string, cache_status string, raw_response string",
    "scorer_results": "run_id string, experiment_id string, eval_id string, scorer_index int, name string, score double, passed boolean, details string",
    "judge_results": "run_id string, experiment_id string, role string, eval_id string, attempts int, overall_score double, passed boolean, confidence double, below_threshold boolean, review_reasons array<string>, review_status string, cache_status string",
    "run_aggregates": f"experiment_id string, role string, scope string, {_SCOPE_RUN}",
    "case_comparisons": "experiment_id string, eval_id string, evaluation_mode string, baseline_score double, baseline_passed boolean, candidate_score double, candidate_passed boolean, score_delta double, transition string",
    "comparison_aggregates": f"experiment_id string, scope string, {_SCOPE_COMPARED}",
    "run_slice_aggregates": f"experiment_id string, role string, cluster_number int, selector string, label_snapshot string, {_SCOPE_RUN}",
    "comparison_slice_aggregates": f"experiment_id string, cluster_number int, selector string, label_snapshot string, {_SCOPE_COMPARED}, baseline_pass_rate double, candidate_pass_rate double, newly_passed array<string>, newly_failed array<string>",
    "gate_violations": "experiment_id string, violation_index int, scope string, scope_kind string, cluster_number int, label_snapshot string, metric string, actual double, allowed double, message string",
}
#: The column whose value owns a row: a commit writes rows of one owner.
OWNER = {
    "traces": None, "rejects": None, "clustering_runs": "clustering_run_id", "cluster_assignments": "clustering_run_id", "cluster_labels": "clustering_run_id",
    "datasets": "dataset_id", "cases": "dataset_id", "slice_builds": "dataset_id", "slice_provenance": "dataset_id", "judge_cache": None,
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
