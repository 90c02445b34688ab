"""Queries that stand for a whole listing or text return all of it."""

import unicodedata
from pathlib import Path

import pytest

from assayer.plans import queries

DATA = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


@here
def test_every_event_newest_first(spark):
    rows = queries.queries()["all_newest_first"](spark, str(DATA)).collect()
    events = queries.table(spark, str(DATA), "events").collect()
    assert len(rows) == len(events) > 100
    assert [r.event_id for r in rows] == [r.event_id for r in sorted(events, key=lambda r: (-r.ts.timestamp(), r.event_id))]


@here
def test_every_result_of_both_runs(spark):
    rows = queries.queries()["run_results"](spark, str(DATA)).collect()
    assert len(rows) == 2 * queries.cases(spark, str(DATA)).count() > 6
    assert [(r.role_order, r.eval_id) for r in rows] == sorted((r.role_order, r.eval_id) for r in rows)


def test_whole_texts_are_folded_and_stripped(spark, tmp_path):
    texts = ["plain STRASSE. Straße \ufb01n \u2460 ", "\u3000First word. \u1e9e\u0130 \u03a3\u03c2 \uff21\uff22\u2028", "", None, "ends. here \u00a0"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folded = {r.doc_id: r for r in queries.queries()["folded_texts"](spark, str(tmp_path)).collect()}
    stripped = {r.doc_id: r.label for r in queries.queries()["stripped_texts"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = (None, None, None) if t is None else (t.casefold(), unicodedata.normalize("NFKC", t.strip()).casefold(), t.strip())
        assert (folded[i].folded, folded[i].label_key, stripped[i]) == want


@here
def test_weights_cover_the_documents_of_all_traces(spark):
    rows = queries.queries()["trace_tfidf_weights"](spark, str(DATA)).select("trace_id").distinct().collect()
    assert {r.trace_id for r in rows} == {r.trace_id for r in queries.traces(spark, str(DATA)).collect()}


@here
def test_kmeans_takes_twenty_starts(spark, monkeypatch):
    taken, real = [], queries.clustering.kmeans
    monkeypatch.setattr(queries.clustering, "kmeans", lambda rows, k, starts: taken.append(starts) or real(rows, k, 1))
    queries.kmeans_slices(spark, str(DATA))
    assert taken == [20]
