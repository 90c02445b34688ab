"""SQL for DuckDB with the same results as plans.queries, by the same names."""

from __future__ import annotations

from assayer.functions.ids import CASE_NAMESPACE
from assayer.functions.text import WHITESPACE
from assayer.operators.judging import CACHE_TAG
from assayer.operators.sampling import ALGORITHM
from assayer.plans.queries import CONFIG_HASH, DATASET, LIMITS, MANIFEST_HASH, SAMPLE_SIZE, SLICE_LIMITS

SPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
NS = CASE_NAMESPACE.replace("-", "")

VIEWS = f"""
traces AS (
  SELECT 'c' || u.conv_id || '-' || u.turn AS trace_id, u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations AS u LEFT JOIN conversations AS a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
), cases AS (
  SELECT 'e-' || trace_id AS eval_id, *, ['deterministic', 'reference', 'rubric'][CAST((conv_id + turn) % 3 + 1 AS INT)] AS evaluation_mode,
    ['critical', 'high', 'medium', 'medium', 'low'][CAST(conv_id % 5 + 1 AS INT)] AS priority, CAST(conv_id % 7 AS INT) AS cluster_number,
    'cluster-' || conv_id % 7 AS selector, CASE WHEN conv_id % 7 % 2 = 0 THEN 'label ' || conv_id % 7 END AS label_snapshot
  FROM traces WHERE length(trim(response, {SPACE})) > 0
), outputs AS (
  SELECT *, 'baseline' AS role, CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 'wrong' ELSE response END AS output FROM cases
  UNION ALL SELECT *, 'candidate', CASE WHEN (conv_id * 11 + turn) % 6 = 0 THEN 'wrong' ELSE response END FROM cases
), results AS (
  SELECT *, score >= 0.5 AS passed FROM (
    SELECT *, CASE WHEN evaluation_mode = 'rubric' THEN ((conv_id * 3 + turn + CASE role WHEN 'baseline' THEN 0 ELSE 2 END) % 5) / 4.0::DOUBLE ELSE CAST(output = response AS INT)::DOUBLE END AS score FROM outputs)
), cmp AS (
  SELECT b.eval_id, b.evaluation_mode, b.score AS baseline_score, b.passed AS baseline_passed, c.score AS candidate_score, c.passed AS candidate_passed, c.score - b.score AS score_delta,
    CASE WHEN b.passed AND c.passed THEN 'passed_both' WHEN NOT b.passed AND NOT c.passed THEN 'failed_both' WHEN c.passed THEN 'newly_passed' ELSE 'newly_failed' END AS transition
  FROM results AS b JOIN results AS c ON b.eval_id = c.eval_id WHERE b.role = 'baseline' AND c.role = 'candidate'
)"""
MEASURES = """count(*) AS case_count, sum(baseline_score) / count(*) AS baseline_score, sum(candidate_score) / count(*) AS candidate_score,
  sum(candidate_score) / count(*) - sum(baseline_score) / count(*) AS score_delta,
  count(*) FILTER (transition = 'newly_passed') AS newly_passed_count, count(*) FILTER (transition = 'newly_failed') AS newly_failed_count"""
AGGREGATES = f"""
agg AS (
  SELECT 'global' AS scope, {MEASURES} FROM cmp HAVING count(*) > 0 UNION ALL SELECT evaluation_mode, {MEASURES} FROM cmp GROUP BY evaluation_mode
), slices AS (
  SELECT cluster_number, selector, label_snapshot, {MEASURES}, count(*) FILTER (baseline_passed) / count(*) AS baseline_pass_rate, count(*) FILTER (candidate_passed) / count(*) AS candidate_pass_rate,
    coalesce(string_agg(eval_id, ',' ORDER BY eval_id) FILTER (transition = 'newly_passed'), '') AS newly_passed,
    coalesce(string_agg(eval_id, ',' ORDER BY eval_id) FILTER (transition = 'newly_failed'), '') AS newly_failed
  FROM cmp JOIN cases USING (eval_id, evaluation_mode) WHERE cluster_number <> 6 GROUP BY cluster_number, selector, label_snapshot
)"""


def _gate(limits: dict, slice_limits: dict) -> str:
    rows = [f"('{s}', CAST(NULL AS INT), {v.max_score_drop}::DOUBLE, {v.max_new_failures}, {i})" for i, (s, v) in enumerate(limits.items())]
    rows += [f"('cluster-{n}', {n}, {v.max_score_drop}::DOUBLE, {v.max_new_failures}, {len(limits) + i})" for i, (n, v) in enumerate(sorted(slice_limits.items()))]
    sliced = "SELECT scope, CAST(NULL AS INT) AS n, CAST(NULL AS VARCHAR) AS label_snapshot, score_delta, newly_failed_count FROM agg"
    if slice_limits:
        sliced += " UNION ALL SELECT selector, cluster_number, label_snapshot, score_delta, newly_failed_count FROM slices"
    kind = "CASE WHEN n IS NOT NULL THEN 'slice' WHEN scope = 'global' THEN 'global' ELSE 'mode' END" if slice_limits else "CAST(NULL AS VARCHAR)"
    return f"""
wanted(scope, n, d, f, place) AS (VALUES {", ".join(rows)}), scopes AS ({sliced}), met AS (
  SELECT s.*, w.d, w.f, w.place, greatest(0.0, -score_delta) AS drop FROM scopes AS s JOIN wanted AS w ON s.scope = w.scope AND s.n IS NOT DISTINCT FROM w.n
), found AS (
  SELECT *, 0 AS k, 'score_drop' AS metric, drop AS actual, d AS allowed, printf('%s score drop %.6f exceeds %.6f', scope, drop, d) AS message FROM met WHERE drop > d
  UNION ALL SELECT *, 1, 'new_failures', newly_failed_count::DOUBLE, f::DOUBLE, printf('%s newly failed count %d exceeds %d', scope, newly_failed_count, f) FROM met WHERE newly_failed_count > f
), violations AS (
  SELECT CAST(row_number() OVER (ORDER BY place, k) - 1 AS INT) AS violation_index, scope, {kind} AS scope_kind, n AS cluster_number, label_snapshot, metric, actual, allowed, message FROM found
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


GATED = _with(VIEWS, AGGREGATES, _gate(LIMITS, SLICE_LIMITS))
DETAIL = f"""{GATED}, detail AS (
  SELECT c.*, coalesce(c.label_snapshot, c.selector) AS slice_label, b.output AS baseline_output, d.output AS candidate_output, b.passed AS baseline_passed, d.passed AS candidate_passed, cmp.score_delta, cmp.transition,
    CASE WHEN c.evaluation_mode = 'rubric' AND c.conv_id % 3 = 0 THEN 'needs_review' ELSE 'not_required' END AS candidate_review_status
  FROM cases AS c JOIN results AS b ON b.eval_id = c.eval_id AND b.role = 'baseline' JOIN results AS d ON d.eval_id = c.eval_id AND d.role = 'candidate' JOIN cmp ON cmp.eval_id = c.eval_id
)"""
RUN = """count(*) AS case_count, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed) AS failed_count, round(sum(score) / count(*), 6) AS score, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate"""
PROPS = """props AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN props || '}' WHEN 1 THEN '{not json' WHEN 2 THEN '[' || props || ']' ELSE props END AS output FROM events)"""
JUDGED = """judged AS (SELECT doc_id, quality::DOUBLE AS s1, (1 - toxic)::DOUBLE AS s2, (n_chars % 100) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 4 = 0 THEN 'critical' ELSE 'high' END AS priority FROM labels JOIN documents USING (doc_id))"""
SIGNALS = f"""{_with(VIEWS)}, signals AS (
  SELECT trace_id, priority = 'critical' AS critical_priority_signal, NOT passed AS prior_failure_signal FROM results WHERE role = 'baseline' AND (priority = 'critical' OR NOT passed)
), candidates AS (
  SELECT *, 2 - CAST(critical_priority_signal AS INT) - CAST(prior_failure_signal AS INT) AS preference_tier FROM (
    SELECT trace_id, CAST(conv_id % 7 AS INT) AS cluster_number, sha256(prompt) AS document_hash, sha256(trace_id) AS source_trace_hash,
      coalesce(critical_priority_signal, false) AS critical_priority_signal, coalesce(prior_failure_signal, false) AS prior_failure_signal
    FROM traces LEFT JOIN signals USING (trace_id) WHERE length(trim(response, {SPACE})) > 0)
), keyed AS (
  SELECT *, sha256('{{"algorithm":"{ALGORITHM}","cluster_number":' || cluster_number || ',"clustering_configuration_hash":"{CONFIG_HASH}","source_manifest_hash":"{MANIFEST_HASH}"}}') AS allocation_key,
    sha256('{{"algorithm":"{ALGORITHM}","cluster_number":' || cluster_number || ',"clustering_configuration_hash":"{CONFIG_HASH}","clustering_source_manifest_hash":"{MANIFEST_HASH}","critical_priority_signal":' || critical_priority_signal
      || ',"document_hash":"' || document_hash || '","preference_tier":' || preference_tier || ',"prior_failure_signal":' || prior_failure_signal || ',"source_trace_hash":"' || source_trace_hash || '","trace_id":"' || trace_id || '"}}') AS selection_key
  FROM candidates
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_number ORDER BY preference_tier, selection_key, trace_id) AS selection_rank FROM keyed
), turns AS (
  SELECT *, row_number() OVER (ORDER BY selection_rank, allocation_key, cluster_number) AS turn FROM ranked
), quota AS (
  SELECT cluster_number, allocation_key, count(*) AS eligible_count, count(*) FILTER (critical_priority_signal) AS critical_count, count(*) FILTER (prior_failure_signal) AS failure_count, count(*) FILTER (turn <= {SAMPLE_SIZE}) AS quota FROM turns GROUP BY ALL
)"""
TERMS = r"""WITH w AS (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w, unnest(range(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')))) AS k FROM benchmark
), plain AS (SELECT item_id, strip_accents(w) AS w, k FROM w),
t AS (SELECT item_id, w AS term FROM plain UNION ALL SELECT * FROM (SELECT item_id, w || ' ' || lead(w) OVER (PARTITION BY item_id ORDER BY k) AS term FROM plain) WHERE term IS NOT NULL),
c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
r AS (SELECT item_id, term, tf, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS raw FROM c JOIN d USING (term)),
v AS (SELECT item_id, term, tf, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS weight FROM r)"""
TRACE_TERMS = f"""{_with(VIEWS)}, texts AS (
  SELECT trace_id AS item_id, CASE WHEN turn % 4 = 1 THEN 'PROMPT:' || chr(10) || prompt || chr(10) || 'CONTEXT_JSON:' || chr(10) || '{{"conv":' || conv_id || '}}' ELSE prompt END AS text FROM traces
), {TERMS.removeprefix("WITH ").replace("FROM benchmark", "FROM texts")}"""
ROUNDED = "round(baseline_score, 6) AS baseline_score, round(candidate_score, 6) AS candidate_score, round(score_delta, 6) AS score_delta, newly_passed_count, newly_failed_count"
ORDERS = """cmp AS (
  SELECT *, CASE WHEN baseline_score >= 0.5 AND candidate_score >= 0.5 THEN 'passed_both' WHEN baseline_score < 0.5 AND candidate_score < 0.5 THEN 'failed_both' WHEN candidate_score >= 0.5 THEN 'newly_passed' ELSE 'newly_failed' END AS transition
  FROM (SELECT o_orderpriority AS evaluation_mode, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS baseline_score, round(count(*) FILTER (l_linestatus = 'O' OR l_quantity > 25) / count(*), 6) AS candidate_score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderpriority)
)"""

SQL: dict[str, str] = {
    "all_newest_first": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts, event_type FROM events ORDER BY events.ts DESC, event_id",
    "document_order": f"{_with(VIEWS)} SELECT trace_id, row_number() OVER (ORDER BY trace_id) - 1 AS document_index FROM traces",
    "score_exact": f"{_with(VIEWS)} SELECT role, eval_id, output = response AS passed FROM outputs WHERE evaluation_mode = 'reference'",
    "score_contains": "SELECT page_id, contains(html, '<Title>') AS exact, contains(lower(html), '<title>') AS folded FROM pages",
    "score_regex": r"SELECT page_id, regexp_matches(url, 'https?://[a-z0-9.\-]+/[a-z]+') AS passed FROM pages",
    "score_json_validity": f"{_with(PROPS)} SELECT event_id, json_valid(output) AS passed FROM props",
    "score_required_keys": f"{_with(PROPS)} SELECT event_id, CASE WHEN json_valid(output) THEN coalesce(json_type(output) = 'OBJECT' AND json_exists(output, '$.k'), false) ELSE false END AS passed FROM props",
    "case_scores": f"""{_with(VIEWS)} SELECT role, eval_id, evaluation_mode, CASE WHEN evaluation_mode = 'reference' THEN CAST(output = response AS INT)::DOUBLE ELSE (CAST(output = response AS INT) + CAST(contains(output, 'e') AS INT)) / 2 END AS score,
      CASE WHEN evaluation_mode = 'reference' THEN output = response ELSE output = response AND contains(output, 'e') END AS passed FROM outputs WHERE evaluation_mode <> 'rubric'""",
    "run_aggregates": f"{_with(VIEWS)} SELECT role, 'global' AS scope, {RUN} FROM results GROUP BY role UNION ALL SELECT role, evaluation_mode, {RUN} FROM results GROUP BY role, evaluation_mode",
    "run_slice_aggregates": f"{_with(VIEWS)} SELECT role, cluster_number, selector, label_snapshot, {RUN} FROM results WHERE cluster_number <> 6 GROUP BY ALL",
    "case_comparisons": f"{_with(VIEWS)} SELECT * FROM cmp",
    "comparison_aggregates": f"{_with(VIEWS, AGGREGATES)} SELECT scope, case_count, {ROUNDED} FROM agg",
    "comparison_slices": f"{_with(VIEWS, AGGREGATES)} SELECT cluster_number, selector, label_snapshot, case_count, {ROUNDED}, round(baseline_pass_rate, 6) AS baseline_pass_rate, round(candidate_pass_rate, 6) AS candidate_pass_rate, newly_passed, newly_failed FROM slices",
    "newly_lists": f"{_with(VIEWS)} SELECT transition, row_number() OVER (PARTITION BY transition ORDER BY eval_id) - 1 AS ordinal, eval_id FROM cmp WHERE transition IN ('newly_passed', 'newly_failed')",
    "gate_violations": f"{GATED} SELECT violation_index, scope, scope_kind, cluster_number, label_snapshot, metric, round(actual, 6) AS actual, round(allowed, 6) AS allowed, message FROM violations",
    "gate_verdict": f"{GATED} SELECT count(*) AS violation_count, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM violations",
    "gate_over_lineitem": f"""{_with(ORDERS, AGGREGATES.split(", slices AS")[0], _gate({"global": type(LIMITS["global"])(0.01, 10), "1-URGENT": type(LIMITS["global"])(0.0, 0)}, {}))}
      SELECT violation_index, scope, scope_kind, cluster_number, label_snapshot, metric, round(actual, 6) AS actual, round(allowed, 6) AS allowed, message FROM violations""",
    "judge_criteria_scores": f"""{_with(JUDGED)} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'overall_score_mismatch' END AS code, CASE WHEN doc_id % 9 <> 0 THEN (s1 + s2) / 2 END AS score, CASE WHEN doc_id % 9 <> 0 THEN s1 >= 0.5 AND s2 >= 0.5 END AS passed FROM judged""",
    "judge_review_state": f"""{_with(JUDGED)}, r AS (SELECT *, confidence < 0.7 AS low, priority = 'critical' AND NOT (s1 >= 0.5 AND s2 >= 0.5) AS critical FROM judged)
      SELECT doc_id, low AS below_threshold, CASE WHEN low OR critical THEN 'needs_review' ELSE 'not_required' END AS review_status, concat_ws(',', CASE WHEN low THEN 'low_confidence' END, CASE WHEN critical THEN 'critical_failure' END) AS review_reasons FROM r""",
    "judge_cache_status": f"""WITH k AS (SELECT doc_id, sha256('{CACHE_TAG[:-1]}' || chr(0) || text) AS cache_key FROM documents), c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id % 2 = 0)
      SELECT CASE WHEN c.cache_key IS NULL THEN 'miss' ELSE 'hit' END AS cache_status, count(*) AS n, min(k.cache_key) AS least_key FROM k LEFT JOIN c USING (cache_key) GROUP BY 1""",
    "historical_signals": f"{SIGNALS} SELECT * FROM signals",
    "eligible_by_slice": f"{SIGNALS} SELECT cluster_number, count(*) AS eligible_count, count(*) FILTER (critical_priority_signal) AS critical_count, count(*) FILTER (prior_failure_signal) AS failure_count FROM candidates GROUP BY cluster_number",
    "sample_quota": f"{SIGNALS} SELECT * FROM quota",
    "sample_selection": f"{SIGNALS} SELECT trace_id, cluster_number, preference_tier, selection_key, CAST(selection_rank AS INT) AS selection_rank FROM turns WHERE turn <= {SAMPLE_SIZE}",
    "source_manifest": f"""{_with(VIEWS)} SELECT 'traces' AS source, sha256('[' || string_agg('{{"document_hash":"' || sha256(prompt) || '","source_trace_hash":"' || sha256(coalesce(response, '')) || '","trace_id":"' || trace_id || '"}}', ',' ORDER BY trace_id) || ']') AS manifest_hash FROM traces
      UNION ALL SELECT 'events', sha256('[' || string_agg('{{"event":' || event_id || ',"type":"' || event_type || '"}}', ',' ORDER BY event_id) || ']') FROM events""",
    "manifest_hash": f"""{_with(VIEWS)} SELECT conv_id, sha256('[' || string_agg('{{"document_hash":"' || sha256(prompt) || '","trace_id":"' || trace_id || '"}}', ',' ORDER BY trace_id) || ']') AS manifest_hash FROM traces GROUP BY conv_id""",
    "eval_ids": f"""{_with(VIEWS)}, h AS (SELECT trace_id, sha1(unhex('{NS}') || encode('["{DATASET}","' || trace_id || '"]')) AS h FROM traces)
      SELECT trace_id, 'eval_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 15) AS eval_id FROM h""",
    "tfidf_weights": f"{TERMS} SELECT item_id, term, tf, df, round(weight, 6) AS weight FROM v",
    "tfidf_norms": f"{TERMS} SELECT item_id, count(*) AS terms, round(sqrt(sum(weight * weight)), 6) AS norm FROM v GROUP BY item_id",
    "trace_tfidf_weights": f"{TRACE_TERMS} SELECT item_id AS trace_id, term, tf, df, round(weight, 6) AS weight FROM v",
    "trace_distinct_vectors": f"{TRACE_TERMS} SELECT count(DISTINCT h) AS distinct_vectors FROM (SELECT string_agg(term || chr(0) || CAST(round(weight, 9) AS VARCHAR), chr(1) ORDER BY term) AS h FROM v GROUP BY item_id)",
    "cluster_numbers": "SELECT vec_id, CAST(dense_rank() OVER (ORDER BY least) - 1 AS INT) AS cluster_number FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS least FROM embeddings)",
    "detail_join": f"{DETAIL} SELECT eval_id, slice_label, priority, baseline_output, candidate_output, baseline_passed, candidate_passed, score_delta, transition FROM detail",
    "overview_metrics": f"""{DETAIL} SELECT count(*) AS case_count, count(*) FILTER (transition = 'newly_passed') AS newly_passed_count, count(*) FILTER (transition = 'newly_failed') AS newly_failed_count,
      count(*) FILTER (transition = 'newly_failed' AND priority = 'critical') AS critical_regression_count, count(*) FILTER (candidate_review_status = 'needs_review') AS review_count, (SELECT count(*) FROM violations) AS gate_violation_count FROM detail""",
    "filter_cases": f"{DETAIL} SELECT eval_id, transition FROM detail WHERE priority = 'medium' AND evaluation_mode = 'reference' AND contains(lower(concat_ws(' ', eval_id, trace_id, prompt, baseline_output, candidate_output)), 'wrong')",
    "review_queue": f"{DETAIL} SELECT CASE WHEN priority = 'critical' THEN 0 ELSE 1 END AS queue_group, eval_id, priority FROM detail WHERE candidate_review_status = 'needs_review' ORDER BY 1, 2",
    "slice_table": f"""{GATED} SELECT cluster_number, coalesce(label_snapshot, selector) AS label, case_count, CASE WHEN selector IN (SELECT scope FROM violations) THEN 'FAIL' WHEN cluster_number IN ({", ".join(map(str, SLICE_LIMITS))}) THEN 'PASS' ELSE 'Not configured' END AS gate_status FROM slices""",
    "latency_summary": """WITH o AS (SELECT event_type, round(value, 2) - 1 AS v FROM events WHERE event_type IN ('view', 'click')), g AS (SELECT avg(v) FILTER (event_type = 'view' AND v > 0) AS b, avg(v) FILTER (event_type = 'click' AND v > 0) AS c, count(*) FILTER (event_type = 'view' AND v > 0) AS nb, count(*) FILTER (event_type = 'click' AND v > 0) AS nc FROM o)
      SELECT nb >= 2 AND nc >= 2 AS available, CASE WHEN nb >= 2 AND nc >= 2 THEN 'Observed provider latency' ELSE 'Unavailable: too few observations' END AS message, nb AS baseline_observations, nc AS candidate_observations,
        round(b, 6) AS baseline_mean_ms, round(c, 6) AS candidate_mean_ms, round(c - b, 6) AS delta_ms FROM g""",
    "orphans": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_partkey",
    "mode_shape": f"{_with(VIEWS)} SELECT eval_id, evaluation_mode FROM cases WHERE (evaluation_mode = 'deterministic' AND (conv_id % 11 = 0 OR conv_id % 13 = 0)) OR (evaluation_mode = 'rubric' AND conv_id % 13 = 0)",
    "current_status": "SELECT user_id AS owner, arg_max(event_type, event_id) AS status, max(event_id) AS sequence FROM events GROUP BY user_id",
    "stripped_texts": f"WITH f AS (SELECT doc_id, trim(chr(9) || ' ' || text || ' ' || chr(12288) || chr(10), {SPACE}) AS label FROM documents) SELECT doc_id, label, sha256(label) AS label_hash FROM f",
    "redaction": """SELECT event_id, '{"auth_token":"[redacted]","nested":[{"API_KEY":"[redacted]","k":{"k":' || json_extract_string(props, '$.k') || '}}]}' AS snapshot FROM events""",
    "priority_means": "SELECT o_orderpriority, round(sum(CAST(round(o_totalprice, 2) / 1000000 AS DECIMAL(28, 18))) / count(*), 6) AS mean, count(*) AS n FROM orders GROUP BY o_orderpriority",
}


EVAL_ID = "'eval_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 15)"
SQL |= {
    "provenance_mismatch": f"{_with(VIEWS)} SELECT eval_id, 'label 3' AS label_snapshot, cluster_number FROM cases WHERE cluster_number = 3",
    "slice_membership": f"{_with(VIEWS)} SELECT cluster_number, count(*) AS case_count, 0 AS members FROM cases WHERE label_snapshot IS NULL GROUP BY cluster_number",
    "violation_scopes": f"{GATED} SELECT scope, scope_kind, metric FROM violations WHERE NOT (scope_kind = 'global' OR scope = 'rubric' OR scope IN (SELECT selector FROM cases WHERE label_snapshot IS NOT NULL))",
    "foreign_results": f"{_with(VIEWS)} SELECT role, eval_id, evaluation_mode FROM results WHERE priority = 'low'",
    "judge_mismatches": f"""{_with(JUDGED)} SELECT CAST(doc_id AS VARCHAR) AS eval_id FROM judged WHERE doc_id % 10 = 3 OR (doc_id % 2 = 0 AND doc_id % 50 = 4)""",
    "assignment_faults": """WITH r AS (SELECT CAST(label AS VARCHAR) AS clustering_run_id, label, vec_id % 7 AS c FROM embeddings)
      SELECT clustering_run_id, count(*) FILTER (c > 5 + label % 2) AS outside FROM r GROUP BY ALL HAVING count(*) FILTER (c > 5 + label % 2) > 0""",
    "mode_partition": f"{_with(VIEWS)} SELECT evaluation_mode, count(*) AS n, min(eval_id) AS first FROM cases GROUP BY evaluation_mode",
    "run_results": f"{_with(VIEWS)} SELECT CASE role WHEN 'baseline' THEN 0 ELSE 1 END AS role_order, 'run-' || role AS run_id, eval_id, score FROM results ORDER BY 1, 3",
    "run_coverage": f"{_with(VIEWS)} SELECT eval_id, true AS baseline, false AS candidate FROM cases WHERE priority = 'high'",
    "judge_counters": f"""{_with(JUDGED)} SELECT CASE WHEN doc_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS role, count(*) FILTER (confidence < 0.7) AS low_confidence,
      count(*) FILTER (confidence < 0.7 OR (priority = 'critical' AND NOT (s1 >= 0.5 AND s2 >= 0.5))) AS needs_review, count(*) FILTER (doc_id % 3 = 0) AS cache_hits, count(*) FILTER (doc_id % 3 <> 0) AS cache_misses FROM judged GROUP BY 1""",
    "critical_failures": f"{_with(VIEWS)} SELECT DISTINCT trace_id AS source_trace_id FROM results WHERE priority = 'critical' AND NOT passed",
    "build_manifest": f"""{SIGNALS}, preferences AS (
      SELECT cluster_number, sha256('[' || string_agg('{{"critical_priority_signal":' || critical_priority_signal || ',"preference_tier":' || preference_tier || ',"prior_failure_signal":' || prior_failure_signal || ',"selection_key":"' || selection_key || '","trace_id":"' || trace_id || '"}}', ',' ORDER BY trace_id) || ']') AS h FROM keyed GROUP BY cluster_number)
      SELECT CAST(n AS INT) AS cluster_number, 'cluster-' || n AS selector, 'label ' || n AS label_snapshot, 'label ' || n AS label_key_snapshot, allocation_key, coalesce(eligible_count, 0) AS eligible_count, coalesce(critical_count, 0) AS critical_count,
        coalesce(failure_count, 0) AS failure_count, coalesce(quota, 0) AS quota, coalesce(h, sha256('[]')) AS preference_manifest_hash
      FROM range(9) AS r(n) LEFT JOIN quota ON quota.cluster_number = n LEFT JOIN preferences ON preferences.cluster_number = n""",
    "built_cases": f"""{SIGNALS}, s AS (
      SELECT trace_id, cluster_number, traces.response, CASE cluster_number WHEN 1 THEN 'rubric' WHEN 2 THEN 'deterministic' ELSE 'reference' END AS mode, sha1(unhex('{NS}') || encode('["{DATASET}","' || trace_id || '"]')) AS h FROM turns JOIN traces USING (trace_id) WHERE turns.turn <= {SAMPLE_SIZE})
      SELECT {EVAL_ID} AS eval_id, trace_id AS source_trace_id, mode AS evaluation_mode, CASE WHEN mode = 'reference' THEN 'medium' ELSE 'high' END AS priority, 'draft' AS review_status, CASE WHEN mode = 'reference' THEN response END AS reference_answer,
        CASE WHEN mode = 'rubric' THEN 'clear' END AS rubric, CAST(CASE WHEN mode = 'deterministic' THEN 1 END AS INT) AS scorers FROM s""",
    "document_texts": f"""{_with(VIEWS)} SELECT trace_id, sha256(CASE WHEN turn % 4 = 1 THEN 'PROMPT:' || chr(10) || prompt || chr(10) || 'CONTEXT_JSON:' || chr(10) || '{{"conv":' || conv_id || '}}' ELSE prompt END) AS document_hash FROM traces""",
    "trace_hashes": """SELECT CAST(event_id AS VARCHAR) AS trace_id, sha256('{"context":{},"metadata":{"a":1},"prompt":"p","response":' || CASE WHEN user_id % 2 = 0 THEN '"r"' ELSE 'null' END || ',"task_type":"' || event_type || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","trace_id":"' || event_id || '"}') AS source_trace_hash FROM events""",
    "folded_texts": f"WITH f AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS w FROM documents) SELECT doc_id, w AS folded, trim(w, {SPACE}) AS label_key FROM f",
    "judge_prompts": f"""{_with(VIEWS)} SELECT eval_id, sha256('Judge.' || chr(10) || chr(10) || '{{"context":{{}},"criteria":["clear","kind"],"input":' || to_json(prompt) || ',"output":' || to_json(response) || '}}') AS request_hash FROM cases WHERE evaluation_mode = 'rubric'""",
}


def oracle_sql() -> dict[str, str]:
    from assayer.plans import library

    return SQL | library.SQL
