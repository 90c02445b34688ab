"""Experiment configuration: strict YAML, prompts, and the hash of everything that decides a result."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from assayer.functions.json_text import canonical_dumps
from assayer.operators.comparing import Limits, effective_limits
from assayer.plans.constraints import CODES


class ConfigError(ValueError):
    """A configuration that doesn't hold; nothing has been written."""


class _Loader(yaml.SafeLoader):
    """A safe loader to which a repeated key is an error."""


def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode, deep: bool = False) -> dict[Any, Any]:
    keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
    if repeated := {str(k) for k in keys if keys.count(k) > 1}:
        raise ConfigError(f"{', '.join(sorted(repeated))} is repeated")
    return yaml.SafeLoader.construct_mapping(loader, node, deep)


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: _mapping(loader, node, True))


@dataclass(frozen=True)
class Prompt:
    text: str
    sha256: str


def load_prompt(path: Path) -> Prompt:
    """A prompt and the hash of its text; line ends stay as they are, a byte order mark goes."""
    try:
        text = path.read_bytes().decode("utf-8-sig")
    except (OSError, UnicodeDecodeError) as error:
        raise ConfigError(f"{path}: {error}") from error
    if not text.strip():
        raise ConfigError(f"{path} is blank")
    return Prompt(text, hashlib.sha256(text.encode()).hexdigest())


@dataclass(frozen=True)
class Side:
    """A role's provider: a fixture file, or a model behind a connector."""

    provider: str
    settings: dict[str, Any]
    prompt: Prompt | None = None


@dataclass(frozen=True)
class Judge:
    provider: str
    settings: dict[str, Any]
    confidence_threshold: float
    prompt: Prompt | None = None
    retry_prompt: Prompt | None = None


@dataclass(frozen=True)
class Config:
    name: str
    dataset: str
    sides: dict[str, Side]
    judge: Judge | None = None
    overall: Limits = field(default_factory=Limits)
    by_mode: dict[str, Limits] = field(default_factory=dict)
    by_slice: dict[str, Limits] = field(default_factory=dict)

    def limits(self) -> dict[str, Limits]:
        return effective_limits(self.overall, self.by_mode)


def _object(value: Any, where: str, needed: set[str], allowed: set[str] = frozenset()) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be a mapping")
    if missing := needed - set(value):
        raise ConfigError(f"{where}: {', '.join(sorted(missing))} must be given")
    if extra := set(value) - needed - allowed:
        raise ConfigError(f"{where}: {', '.join(sorted(map(str, extra)))} isn't known")
    return value


def _number(value: Any, where: str, most: float = math.inf) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= most:
        raise ConfigError(f"{where} must be a number from 0" + (f" to {most:g}" if most < math.inf else ""))
    return float(value)


def _limits(value: Any, where: str) -> Limits:
    held = _object(value, where, set(), {"max_score_drop", "max_new_failures"})
    drop, failures = held.get("max_score_drop"), held.get("max_new_failures")
    if failures is not None and (isinstance(failures, bool) or not isinstance(failures, int) or failures < 0):
        raise ConfigError(f"{where}: max_new_failures must be a whole number from 0")
    return Limits(None if drop is None else _number(drop, where, 1.0), failures)


def placed(file: Path, path: str) -> str:
    """A path beside the configuration file; one with a scheme stays as it is."""
    return path if "://" in path else str(file.parent / path)


def load_config(path: str) -> Config:
    """Reads and checks a configuration file; paths in it are relative to it."""
    file = Path(path)
    try:
        value = yaml.load(file.read_text("utf-8-sig"), _Loader)  # noqa: S506  a safe loader
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as error:
        raise ConfigError(f"{path}: {error}") from error
    held = _object(value, path, {"schema_version", "name", "dataset", "baseline", "candidate"}, {"judge", "gate"})
    if held["schema_version"] != 1 or isinstance(held["schema_version"], bool):
        raise ConfigError(f"{path}: schema_version must be 1")
    for name in ("name", "dataset"):
        if not isinstance(held[name], str) or not held[name].strip():
            raise ConfigError(f"{path}: {name} must be text that isn't blank")
    sides = {}
    for role in CODES["role"]:
        side = _object(held[role], role, {"provider"}, {"path", "model", "base_url", "temperature", "seed", "timeout", "prompt"})
        if side["provider"] == "fixture" and "path" not in side:
            raise ConfigError(f"{role}: a fixture needs a path")
        settings = {k: v for k, v in side.items() if k not in ("provider", "prompt")}
        if "path" in settings:
            settings["path"] = placed(file, settings["path"])
        sides[role] = Side(side["provider"], settings, load_prompt(file.parent / side["prompt"]) if "prompt" in side else None)
    judge = None
    if held.get("judge") is not None:
        j = _object(held["judge"], "judge", {"provider"}, {"path", "model", "base_url", "temperature", "seed", "timeout", "confidence_threshold", "prompt", "retry_prompt"})
        settings = {k: v for k, v in j.items() if k not in ("provider", "prompt", "retry_prompt", "confidence_threshold")}
        if "path" in settings:
            settings["path"] = placed(file, settings["path"])
        prompts = [load_prompt(file.parent / j[k]) if k in j else None for k in ("prompt", "retry_prompt")]
        judge = Judge(j["provider"], settings, _number(j.get("confidence_threshold", 0.7), "confidence_threshold", 1.0), *prompts)
    gate = _object(held.get("gate") or {}, "gate", set(), {"max_score_drop", "max_new_failures", "by_mode", "by_slice"})
    by_mode = {m: _limits(v, f"by_mode {m}") for m, v in (gate.get("by_mode") or {}).items()}
    if unknown := set(by_mode) - set(CODES["evaluation_mode"]):
        raise ConfigError(f"by_mode: {', '.join(sorted(unknown))} isn't a mode")
    by_slice = {str(s): _limits(v, f"by_slice {s}") for s, v in (gate.get("by_slice") or {}).items()}
    overall = _limits({k: gate[k] for k in ("max_score_drop", "max_new_failures") if k in gate}, "gate")
    return Config(held["name"].strip(), held["dataset"].strip(), sides, judge, overall, by_mode, by_slice)


def configuration_hash(config: Config, dataset: dict[str, Any], outputs: dict[str, Any]) -> str:
    """sha256 of what decides the result: neither the experiment's name nor where files lie."""
    side = lambda s: {"provider": s.provider, "settings": {k: v for k, v in s.settings.items() if k != "path"}, "prompt": s.prompt and s.prompt.sha256}
    pair = lambda v: {"max_score_drop": v.max_score_drop, "max_new_failures": v.max_new_failures}
    judge = config.judge and side(config.judge) | {"confidence_threshold": config.judge.confidence_threshold, "retry_prompt": config.judge.retry_prompt and config.judge.retry_prompt.sha256}
    value = {
        "schema_version": 1,
        "dataset": dataset,
        **{r: side(s) for r, s in config.sides.items()},
        "outputs": outputs,
        "judge": judge,
        "gate": {"scopes": {s: pair(v) for s, v in config.limits().items()}, "by_slice": {s: pair(v) for s, v in config.by_slice.items()}},
    }
    return hashlib.sha256(canonical_dumps(value).encode()).hexdigest()
