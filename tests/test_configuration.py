"""Configuration files, prompts, scorers, selectors, addresses and JSON for people: what is taken and what is refused."""

import hashlib
import tempfile
from pathlib import Path

from assayer.operators import comparing, scoring
from assayer.operators.comparing import Limits
from assayer.plans import config, export
from assayer.plans.library import CONFIG
from assayer.sources import http_provider


def tried(tries):
    out = {}
    for what, attempt in tries.items():
        try:
            got = attempt()
        except ValueError as error:
            got = type(error).__name__
        out[what] = str(got)
    return out


def test_experiment_config():
    """A configuration file, its limits by scope, its hash, and what it refuses."""
    want = {"name": "talks", "dataset": "talks:1", "global": "0.01 5", "rubric": "0.02 5", "threshold": "0.7", "same for another name": "True", "same for other limits": "False", "key twice": "ConfigError", "unknown key": "ConfigError", "version true": "ConfigError", "number as text": "ConfigError", "fixture without path": "ConfigError"}

    def load(text: str):
        with tempfile.TemporaryDirectory() as folder:
            path = Path(folder) / "c.yaml"
            path.write_text(text, "utf-8")
            return config.load_config(str(path))

    held = load(CONFIG)
    hashed = lambda c: config.configuration_hash(c, {"id": "d"}, {})
    limits = held.limits()
    tries = {"name": lambda: held.name, "dataset": lambda: held.dataset} | {s: lambda s=s: f"{limits[s].max_score_drop} {limits[s].max_new_failures}" for s in ("global", "rubric")}
    tries |= {
        "threshold": lambda: held.judge.confidence_threshold, "same for another name": lambda: hashed(load(CONFIG.replace("name: talks", "name: other"))) == hashed(held), "same for other limits": lambda: hashed(load(CONFIG.replace("0.02", "0.03"))) == hashed(held),
        "key twice": lambda: load(CONFIG + "name: again\n"), "unknown key": lambda: load(CONFIG + "more: 1\n"), "version true": lambda: load(CONFIG.replace("schema_version: 1", "schema_version: true")), "number as text": lambda: load(CONFIG.replace("0.01", "'0.01'")), "fixture without path": lambda: load(CONFIG.replace(", path: baseline", "")),
    }
    assert tried(tries) == want


def test_prompt_files():
    """A prompt's hash without its byte order mark, line ends kept; blank and broken files."""
    want = {"hash": hashlib.sha256("Judge\r\nwell é".encode()).hexdigest(), "blank": "ConfigError", "other bytes": "ConfigError"}
    with tempfile.TemporaryDirectory() as folder:
        home = Path(folder)
        for name, held in {"good": "﻿Judge\r\nwell é".encode(), "blank": b" \n", "bytes": b"\xff\xfe\xff"}.items():
            (home / name).write_bytes(held)
        assert tried({"hash": lambda: config.load_prompt(home / "good").sha256, "blank": lambda: config.load_prompt(home / "blank"), "other bytes": lambda: config.load_prompt(home / "bytes")}) == want


def test_scorer_registry():
    """Scorers and their settings, checked."""
    want = {"exact_match": "exact_match", "unknown": "ScorerError", "missing": "ScorerError", "extra": "ScorerError", "blank substring": "ScorerError", "bad pattern": "ScorerError", "keys twice": "ScorerError", "json_validity": "json_validity", "keys": "('a', 'b')"}
    p = scoring.prepare
    assert tried({"exact_match": lambda: p("exact_match", {"expected": "x"}).name, "unknown": lambda: p("other", {}), "missing": lambda: p("regex", {}), "extra": lambda: p("json_validity", {"x": 1}), "blank substring": lambda: p("contains", {"substring": " "}), "bad pattern": lambda: p("regex", {"pattern": "("}), "keys twice": lambda: p("required_keys", {"keys": ["a", " a"]}), "json_validity": lambda: p("json_validity", {}).name, "keys": lambda: p("required_keys", {"keys": [" a", "b"]}).keys}) == want


def test_slice_selectors():
    """Selectors by number and by label, and limits by slice."""
    want = {"number": "2", "label": "1", "folded label": "1", "unknown": "ComparisonError", "limits": "{1: 0.5, 2: 0.25}", "one slice twice": "ComparisonError"}
    slices = [(0, None), (1, "Refunds"), (2, None)]
    resolve = lambda s: comparing.resolve_selector(s, slices)
    limits = lambda *names: {n: v.max_score_drop for n, v in sorted(comparing.slice_limits({s: Limits(0.5 / (i + 1), 1) for i, s in enumerate(names)}, slices).items())}
    assert tried({"number": lambda: resolve("cluster-2"), "label": lambda: resolve("Refunds"), "folded label": lambda: resolve(" refunds "), "unknown": lambda: resolve("cluster-9"), "limits": lambda: limits("Refunds", "cluster-2"), "one slice twice": lambda: limits("Refunds", "cluster-1")}) == want


def test_provider_addresses():
    """Addresses of models behind HTTP."""
    want = {"plain": "http://localhost:11434", "path": "ValueError", "user": "ValueError", "scheme": "ValueError", "port": "ValueError"}
    f = http_provider.base_url
    assert tried({"plain": lambda: f("http://LOCALHOST:11434/"), "path": lambda: f("http://localhost/api?x=1"), "user": lambda: f("http://a:b@localhost"), "scheme": lambda: f("ftp://localhost"), "port": lambda: f("http://localhost:99999")}) == want


def test_pretty_json():
    """JSON for people."""
    want = {"sorted": '{\n  "a": [\n    1\n  ],\n  "é": null\n}', "not finite": "This can't be shown as JSON."}
    assert tried({"sorted": lambda: export.pretty({"é": None, "a": [1]}), "not finite": lambda: export.pretty({"a": float("nan")})}) == want
