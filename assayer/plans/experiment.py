"""Experiments: preflight, both roles' runs, comparison, gate and report, with a trail of states."""

from __future__ import annotations

import json
import uuid
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ids import sha256
from assayer.functions.json_text import canonical_dumps, quote, redacted
from assayer.functions.ordering import ordered_digest
from assayer.functions.shared import at_once, scratch, written
from assayer.operators import comparing, judging, scoring
from assayer.plans import constraints, reports
from assayer.plans.config import Config, ConfigError, configuration_hash
from assayer.plans.log import Change
from assayer.plans.store import Catalog
from assayer.sources import fixtures, http_provider
from assayer.sources.journal import Journal


class OperationalError(RuntimeError):
    """A failure after an experiment was accepted; stage says where."""

    def __init__(self, experiment_id: str, stage: str, message: str):
        super().__init__(f"{stage}: {message}")
        self.experiment_id, self.stage = experiment_id, stage


def generation_prompt(template: str, prompt: F.Column, context_json: F.Column) -> F.Column:
    """What a provider is asked: the template, the context unless empty, the prompt."""
    context = F.when(context_json != "{}", F.concat(F.lit("Context (JSON):\n"), context_json, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(template.rstrip() + "\n\n"), context, F.lit("Input:\n"), prompt)


def connector(where: str, provider: str, settings: dict[str, Any], as_json: bool = False) -> http_provider.HttpProvider:
    """The connector that a configuration names, or ConfigError."""
    if provider != "ollama":
        raise ConfigError(f"{where}: no provider is named {provider!r}")
    if not isinstance(settings.get("model"), str) or not settings["model"].strip():
        raise ConfigError(f"{where}: a model is needed")
    try:
        url = http_provider.base_url(settings.get("base_url", "http://127.0.0.1:11434"))
    except ValueError as error:
        raise ConfigError(f"{where}: {error}") from error
    return http_provider.HttpProvider(url, settings["model"].strip(), float(settings.get("temperature", 0)), int(settings.get("seed", 42)), float(settings.get("timeout", 120)), as_json)


def _identities(prompts: dict[str, str], provider: dict[str, Any]):
    """A function of columns: the canonical identity of each judgment."""

    @F.pandas_udf(T.StringType())
    def made(context: pd.Series, rubric: pd.Series, task: pd.Series, output: pd.Series, priority: pd.Series, sequence: pd.Series) -> pd.Series:
        rows = zip(context, rubric, task, output, priority, sequence, strict=True)
        return pd.Series([judging.cache_identity({"context": json.loads(c), "criteria": list(r), "input": t, "priority": p}, o, prompts, provider | {"sequence": s}) for c, r, t, o, p, s in rows], dtype=object)

    return made


class Experiment:
    """One attempt. run() returns its id; results are tables of the catalog."""

    def __init__(self, catalog: Catalog, config: Config):
        self.catalog, self.config, self.spark = catalog, config, catalog.spark
        self.journals: dict[str, Journal] = {}

    # Preflight: nothing is written

    def prepare(self) -> None:
        self.dataset = self.catalog.find_dataset(self.config.dataset)
        self.cases = self.catalog.read("cases").filter(F.col("dataset_id") == self.dataset)
        modes = {r[0] for r in self.cases.select("evaluation_mode").distinct().collect()}
        if not modes:
            raise ConfigError(f"{self.config.dataset} has no cases")
        if absent := set(self.config.by_mode) - modes:
            raise ConfigError(f"the dataset has no {', '.join(sorted(absent))} cases")
        if ("rubric" in modes) != (self.config.judge is not None):
            raise ConfigError("rubric cases and a judge need each other")
        self.members = self.catalog.read("slice_provenance").filter(F.col("dataset_id") == self.dataset).select("eval_id", "cluster_number", "selector", "label_snapshot")
        definition = F.concat(quote(F.col("eval_id")), F.lit(":"), quote(F.to_json(F.struct(*sorted(self.cases.columns)))))
        read = [lambda r=role, s=side: self._fixture(r, s) for role, side in self.config.sides.items()]
        *_, self.responses, slices, cases_hash = found = at_once(
            self.spark,
            lambda: constraints.check_empty(judging.rubric_faults(self.cases), "rubrics that don't hold"), self._check_scorers, *read, self._judge_fixture,
            lambda: [(r.cluster_number, r.label_snapshot) for r in self.members.select("cluster_number", "label_snapshot").distinct().collect()],
            lambda: ordered_digest(self.cases, definition, F.col("eval_id")),
        )
        self.outputs = self.spark.createDataFrame([], "role string, eval_id string, output string").limit(0)
        for rows in filter(None, found[2 : 2 + len(read)]):
            self.outputs = self.outputs.unionByName(rows)
        self.sliced = bool(slices)
        if self.config.by_slice and not self.sliced:
            raise ConfigError("limits by slice need a dataset built from slices")
        self.slice_limits = comparing.slice_limits(self.config.by_slice, slices)
        made = ordered_digest(self.outputs, F.concat(quote(F.concat("role", F.lit(":"), "eval_id")), F.lit(":"), quote(F.col("output"))), F.concat("role", F.lit(":"), "eval_id"))
        self.configuration = configuration_hash(self.config, {"id": self.dataset, "cases": cases_hash}, {"generated": made})

    def _check_scorers(self) -> None:
        if (fault := self.cases.select(F.min(scoring.scorer_faults("scorers"))).head()[0]) is not None:
            raise scoring.ScorerError(fault)

    def _fixture(self, role: str, side: Any) -> DataFrame | None:
        """A role's outputs where they come from a fixture, which has one of each case."""
        if side.provider != "fixture":
            connector(role, side.provider, side.settings)
            return None
        rows = fixtures.read_outputs(self.spark, side.settings["path"], role)
        fixtures.check_coverage(self.cases, rows, ["eval_id"], role)
        return rows

    def _judge_fixture(self) -> DataFrame | None:
        """The same of the judge's responses."""
        judge = self.config.judge
        if judge is None or judge.provider != "fixture":
            if judge is not None:
                connector("judge", judge.provider, judge.settings)
            return None
        rows = fixtures.read_judge(self.spark, judge.settings["path"])
        fixtures.check_coverage(fixtures.expected_judgments(self.cases), rows, ["role", "eval_id"], "judge")
        return rows

    # The attempt

    def run(self) -> str:
        self.prepare()
        c, x = self.catalog, f"experiment_{uuid.uuid4().hex}"
        self.id, runs = x, {r: f"run_{uuid.uuid4().hex}" for r in comparing.ROLES}
        with c.change() as start:
            start.put("experiments", [{"experiment_id": x, "name": self.config.name, "dataset_id": self.dataset, "configuration_hash": self.configuration}])
            start.put("runs", [self._run(r, runs[r], s) for r, s in self.config.sides.items()])
            if j := self.config.judge:
                start.put("judges", [{"experiment_id": x, "provider": j.provider, "model": j.settings.get("model"), "confidence_threshold": j.confidence_threshold, "prompt_hash": j.prompt.sha256 if j.prompt else None, "retry_prompt_hash": j.retry_prompt.sha256 if j.retry_prompt else None}])
            c.move("experiment_events", "experiment_id", x, "running", start)
            for r in runs.values():
                c.move("run_events", "run_id", r, "pending", start, experiment_id=x)
        stage = "preparation"
        try:
            scored = []
            for role, run in runs.items():
                stage = role
                c.move("run_events", "run_id", run, "running", experiment_id=x)
                scored.append(self._role(role, run))
                with c.change() as end:
                    self._audit(role, run, end)
                    c.move("run_events", "run_id", run, "completed", end, experiment_id=x)
            stage = "comparison"
            self._compare(scored[0].unionByName(scored[1]))
        except Exception as error:
            with c.change() as end:
                for role, r in runs.items():
                    self._audit(role, r, end)
                    last = c.last_event("run_events", "run_id", r)["status"]
                    if constraints.NEXT[last]:
                        c.move("run_events", "run_id", r, "skipped" if last == "pending" else "failed", end, experiment_id=x, failure_message=None if last == "pending" else str(error)[:500])
                c.move("experiment_events", "experiment_id", x, "failed", end, failure_stage=stage, failure_message=str(error)[:500])
            raise OperationalError(x, stage, str(error)) from error
        return x

    def _run(self, role: str, run: str, side: Any) -> dict[str, Any]:
        settings = canonical_dumps(redacted({k: v for k, v in side.settings.items() if k != "path"}))
        return {"run_id": run, "experiment_id": self.id, "role": role, "provider": side.provider, "model": side.settings.get("model"), "prompt_hash": side.prompt.sha256 if side.prompt else None, "settings_json": settings}

    def _commit(self, table: str, rows: DataFrame, within: Change | None = None) -> DataFrame:
        """Writes rows of this experiment and returns them as stored."""
        with self.catalog.change(within) as change:
            return change.add(table, rows.withColumn("experiment_id", F.lit(self.id)))

    def _generated(self, role: str) -> DataFrame:
        """(role, eval_id, output, latency_ms) of all cases, from the fixture or the connector."""
        side = self.config.sides[role]
        if side.provider == "fixture":
            return self.outputs.filter(F.col("role") == role).withColumns({"latency_ms": F.lit(None).cast("double"), "metadata": F.lit(None).cast("string")})
        prompt = generation_prompt(side.prompt.text if side.prompt else "Answer the input.", F.col("prompt"), F.coalesce("context_json", F.lit("{}")))
        rows = self.cases.select(F.lit(role).alias("role"), "eval_id", prompt.alias("prompt"))
        return http_provider.generate(rows, connector(role, side.provider, side.settings), self._journal(f"{role}-outputs"))

    def _journal(self, stage: str) -> Journal:
        """A stage's journal, which executors share; what it has of the stage's requests is stored when the stage ends, well or not."""
        self.journals[stage] = Journal(scratch(self.spark, f"requests-{stage}"))
        return self.journals[stage]

    def _audit(self, role: str, run: str, change: Change) -> None:
        for stage in [s for s in self.journals if s.startswith(f"{role}-")]:
            self._commit("requests", self.journals.pop(stage).entries(self.spark).withColumn("run_id", F.lit(run)), change)

    def _role(self, role: str, run: str) -> DataFrame:
        # outputs are stored before they are scored: a request is never made twice for one attempt
        asked = self._commit("outputs", self._generated(role).withColumn("run_id", F.lit(run)))
        latency = asked.select("eval_id", "latency_ms")
        jobs = [lambda: written(scoring.score_cases(self.cases, asked.select("role", "eval_id", "output")).join(latency, "eval_id"), "scored")]
        if self.config.judge is not None:
            jobs.append(lambda: self._judge(role, run, asked).join(latency, "eval_id"))
        first, *others = at_once(self.spark, *jobs)
        rows = first.unionByName(others[0]) if others else first
        stored, _ = at_once(
            self.spark,
            lambda: self._commit("case_results", rows.withColumn("run_id", F.lit(run))),
            lambda: self._commit("scorer_results", rows.select(F.lit(run).alias("run_id"), "eval_id", F.explode("results").alias("r")).select("run_id", "eval_id", "r.*")),
        )
        return stored

    def _judge(self, role: str, run: str, asked: DataFrame) -> DataFrame:
        """Rubric cases judged: looked up in the cache first, asked where missing, the answers kept for later."""
        judge, c = self.config.judge, self.catalog
        cases = self.cases.filter("evaluation_mode = 'rubric'").join(asked.select("eval_id", "output"), "eval_id").withColumn("role", F.lit(role))
        identity = {k: v for k, v in judge.settings.items() if k not in ("path", "timeout")} | {"provider": judge.provider}
        sequence = F.lit("")
        if self.responses is not None:  # a fixture's answer is part of what was asked
            cases = cases.join(self.responses, ["role", "eval_id"])
            sequence = F.concat(F.lit(f"{role}:"), "eval_id", F.lit(":"), sha256(F.to_json("outputs")))
        prompts = {"version": "1", "primary": judge.prompt.sha256 if judge.prompt else "", "retry": judge.retry_prompt.sha256 if judge.retry_prompt else ""}
        name = _identities(prompts, identity)(F.coalesce("context_json", F.lit("{}")), F.col("rubric"), F.col("prompt"), F.col("output"), F.col("priority"), sequence)
        keyed = cases.withColumn("identity_json", name).withColumn("cache_key", judging.cache_key(F.col("identity_json")))
        cache = c.read("judge_cache")
        held = written(judging.look_up(keyed, cache), "looked-up")
        if c.log.holds("judge_cache"):
            constraints.check_empty(judging.cache_faults(held.select("cache_key", "identity_json"), cache), "cached judgments that don't hold")
        self._commit("judge_lookups", held.withColumn("run_id", F.lit(run)))
        hits = held.filter("cache_status = 'hit'").select("role", "eval_id", F.array("raw_response").alias("outputs"))
        misses = held.filter("cache_status = 'miss'")
        if self.responses is not None:
            fresh = misses.select("role", "eval_id", "outputs")
        else:
            text = judging.request_prompt(judge.prompt.text if judge.prompt else "Judge the output by each criterion.", F.col("prompt"), F.col("output"), F.col("rubric"), F.col("context_json"))
            fresh = http_provider.judge(misses.select("role", "eval_id", text.alias("prompt"), "rubric"), connector("judge", judge.provider, judge.settings, True), judge.retry_prompt.text if judge.retry_prompt else "The answer didn't hold. Answer again.", self._journal(f"{role}-judge"))
        answers = self._commit("judge_answers", hits.unionByName(fresh).withColumn("run_id", F.lit(run)))
        asked_for = held.select("eval_id", "evaluation_mode", "priority", "rubric", "output", "cache_status", "cache_key", "identity_json")
        judged = written(judging.judged(asked_for.join(answers.select("role", "eval_id", "outputs"), "eval_id"), judge.confidence_threshold), "judged").withColumn("run_id", F.lit(run))
        attempts = judged.select("run_id", "eval_id", F.posexplode(F.slice("outputs", 1, F.col("attempts"))), "attempts", "code", "error")
        final = (F.col("pos") + 1 == F.col("attempts")) & F.col("code").isNotNull()
        tried = attempts.select("run_id", "eval_id", (F.col("pos") + 1).alias("attempt"), F.col("col").alias("raw_response"), F.when(final, F.col("code")).when(F.col("pos") + 1 < F.col("attempts"), "malformed").alias("error_code"), F.when(final, F.col("error")).alias("error"))
        at_once(self.spark, lambda: self._commit("judge_attempts", tried), lambda: constraints.check_empty(judged.filter(F.col("code").isNotNull()).select("eval_id", "code", "error"), "judgments that don't hold"))
        made = judged.filter("cache_status = 'miss'").select("cache_key", "identity_json", F.element_at("outputs", F.col("attempts")).alias("raw_response"), F.current_timestamp().alias("written_at"))

        def keep() -> None:
            with c.change() as change:  # whoever stored a key first keeps it; this run goes on with its own answers
                change.first("judge_cache", "cache_key", judging.new_entries(made, c.read("judge_cache")))

        at_once(self.spark, keep, lambda: self._commit("judge_results", judged))
        listed = F.transform("criteria", lambda x, i: F.struct(i.cast("int").alias("scorer_index"), F.lit("rubric").alias("name"), x["score"].alias("score"), x["passed"].alias("passed"), F.to_json(F.struct(x["criterion"].alias("criterion"), x["reason"].alias("reason"))).alias("details")))
        return judged.select("role", "eval_id", "evaluation_mode", "output", "score", "passed", listed.alias("results"))

    def _compare(self, results: DataFrame) -> None:
        """Stores the comparison, its gate and the end of the experiment in one change."""
        with self.catalog.change() as change:
            _, _, cases = at_once(
                self.spark,
                lambda: constraints.check_empty(comparing.coverage_gaps(results), "cases that the runs don't share"),
                lambda: self._commit("run_aggregates", comparing.run_aggregates(results), change),
                lambda: self._commit("case_comparisons", comparing.compare_cases(results), change),
            )
            scopes = self._commit("comparison_aggregates", comparing.comparison_aggregates(cases), change)
            slices = None
            if self.sliced:
                self._commit("run_slice_aggregates", comparing.run_slice_aggregates(results, self.members), change)
                slices = self._commit("comparison_slice_aggregates", comparing.comparison_slices(cases, self.members), change)
            found = self._commit("gate_violations", comparing.gate_violations(scopes, self.config.limits(), slices, self.slice_limits), change)
            self.catalog.move("experiment_events", "experiment_id", self.id, "completed", change, verdict=comparing.verdict(found).head().verdict)


def load_detail(catalog: Catalog, experiment_id: str) -> DataFrame:
    """A wide row for each case of an experiment."""
    mine = lambda t: catalog.read(t).filter(F.col("experiment_id") == experiment_id)
    experiment = mine("experiments").head()
    if experiment is None:
        raise ConfigError(f"{experiment_id} doesn't exist")
    cases = catalog.read("cases").filter(F.col("dataset_id") == experiment.dataset_id)
    members = catalog.read("slice_provenance").filter(F.col("dataset_id") == experiment.dataset_id).select("eval_id", "cluster_number", "selector", "label_snapshot")
    cases = cases.join(members, "eval_id", "left").withColumn("slice_label", reports.slice_label(F.col("label_snapshot"), F.col("selector")))
    judged = mine("judge_results").select("role", "eval_id", "confidence", "review_status", "review_reasons")
    last = mine("experiment_events").orderBy(F.desc("sequence")).head()
    if last and last.status == "completed":
        check_coverage(cases, mine("case_results"), mine("case_comparisons"))
    results = mine("case_results").join(judged, ["role", "eval_id"], "left")
    return reports.detail(cases, results, mine("case_comparisons"))


def check_coverage(cases: DataFrame, results: DataFrame, comparisons: DataFrame) -> None:
    """Raises where a completed experiment's rows aren't one result of each case and role, in its mode, and one comparison of each case."""
    wanted = cases.select("eval_id", F.explode(F.array(*map(F.lit, comparing.ROLES))).alias("role"))
    constraints.check_empty(fixtures.coverage_faults(wanted, results.select("role", "eval_id"), ["role", "eval_id"]), "results that don't cover the cases")
    constraints.check_empty(fixtures.coverage_faults(cases.select("eval_id"), comparisons.select("eval_id"), ["eval_id"]), "comparisons that don't cover the cases")
    constraints.check_empty(constraints.repeated(results, "role", "eval_id"), "results stored twice")
    constraints.check_empty(constraints.repeated(comparisons, "eval_id"), "comparisons stored twice")
    for rows, what in ((results, "results of another mode"), (comparisons, "comparisons of another mode")):
        constraints.check_empty(constraints.foreign_results(rows, cases), what)


def load_report(catalog: Catalog, experiment_id: str) -> dict[str, Any]:
    """The report of an experiment from its rows alone; optional parts are left out, not null."""
    mine = lambda t: catalog.read(t).filter(F.col("experiment_id") == experiment_id)
    experiment = mine("experiments").head()
    if experiment is None:
        raise ConfigError(f"{experiment_id} doesn't exist")
    last = mine("experiment_events").orderBy(F.desc("sequence")).head()
    listed = lambda df, *drop: [{k: v for k, v in r.asDict().items() if k not in ("experiment_id", *drop)} for r in df.collect()]  # noqa: E731  scopes and slices, not cases
    out: dict[str, Any] = {"schema_version": 1, "experiment_id": experiment_id, "name": experiment.name, "dataset_id": experiment.dataset_id, "configuration_hash": experiment.configuration_hash, "status": last.status, "verdict": last.verdict}
    if last.failure_stage:
        out |= {"failure_stage": last.failure_stage, "failure_message": last.failure_message}
    order = lambda rows: sorted(rows, key=lambda r: (r["scope"] != "global", r["scope"]))
    runs = listed(mine("run_aggregates"))
    out["runs"] = {role: order([{k: v for k, v in r.items() if k != "role"} for r in runs if r["role"] == role]) for role in comparing.ROLES}
    out["comparison"] = order(listed(mine("comparison_aggregates")))
    for r in comparing.newly_lists(mine("case_comparisons")).orderBy("transition", "ordinal").toLocalIterator():
        out.setdefault(r.transition, []).append(r.eval_id)
    if slices := listed(mine("comparison_slice_aggregates").orderBy("cluster_number")):
        out |= {"schema_version": 2, "slices": slices}
    out["providers"] = {r.role: {"provider": r.provider, "settings": json.loads(r.settings_json)} for r in mine("runs").collect()}
    out["violations"] = listed(mine("gate_violations").orderBy("violation_index"))
    counted = mine("judge_results")
    if not counted.isEmpty():
        out["judge"] = [r.asDict() for r in judging.counters(counted).orderBy("role").collect()]
    return out
