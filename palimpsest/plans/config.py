"""Configuration from YAML, with ${NAME} and ${NAME:default} from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from typing import Any

from palimpsest.functions.strategies import get_strategy


def expand(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    if not isinstance(value, str):
        return value

    def found(m: re.Match) -> str:
        name, default = m[1], m[3]
        if name in os.environ:
            return os.environ[name]
        if default is None:
            raise ValueError(f"environment variable {name} isn't set")
        return default

    return re.sub(r"\$\{(\w+)(:([^}]*))?\}", found, value)


def _known(kind: type, given: dict | None) -> Any:
    given = given or {}
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings for {kind.__name__.lower()}: {', '.join(sorted(unknown))}")
    return kind(**given)


@dataclass
class Detection:
    sample_size: int = 100
    use_patterns: bool = True
    use_history: bool = True
    pattern_min_ratio: float = 0.9
    pattern_min_samples: int = 20
    date_order: str = "MDY"
    overrides_file: str | None = None
    skip_column_patterns: list[str] = field(default_factory=list)
    skip_table_patterns: list[str] = field(default_factory=list)
    user_id: str = "palimpsest"


@dataclass
class Llm:
    enabled: bool = False
    provider: str = "http"
    options: dict = field(default_factory=dict)
    budget: int = 1_000_000
    sample_size: int = 50
    send_values: bool = True
    min_confidence: float = 0.8

    def __post_init__(self):
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be from 0 to 1")


@dataclass
class SeedMapSettings:
    enabled: bool = True
    path: str | None = None
    salt: str | None = None
    untracked: list[str] = field(default_factory=lambda: ["null", "blank", "redact"])


@dataclass
class Masking:
    column_strategies: dict[str, str] = field(default_factory=dict)
    rule_strategies: dict[str, str] = field(default_factory=dict)
    default_strategy: str = "format_random"
    seed: str = "palimpsest"
    null_placeholders: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        for name in [*self.column_strategies.values(), *self.rule_strategies.values(), self.default_strategy]:
            get_strategy(name)
        for column, markers in self.null_placeholders.items():
            if not markers or any(not m.strip() for m in markers) or len(set(markers)) < len(markers):
                raise ValueError(f"null placeholders of {column} must be different and not blank")
        self.column_strategies = {k.lower(): v for k, v in self.column_strategies.items()}


@dataclass
class Validation:
    check_row_count: bool = True
    check_schema: bool = True
    check_completeness: bool = True
    pk_row_limit: int | None = 5000
    ignore_test_data: bool = True
    columns: list[str] = field(default_factory=list)

    def __post_init__(self):
        for name in self.columns:
            if len(name.split(".")) != 3 or not all(name.split(".")):
                raise ValueError("columns to validate are named schema.table.column")


@dataclass
class Config:
    source: str = ""
    target: str = ""
    keys: dict[str, list[str]] = field(default_factory=dict)
    generated: dict[str, list[str]] = field(default_factory=dict)
    schemas: list[str] = field(default_factory=list)
    history: str | None = None
    runs: str = ".palimpsest/runs"
    detection: Detection = field(default_factory=Detection)
    llm: Llm = field(default_factory=Llm)
    seed_map: SeedMapSettings = field(default_factory=SeedMapSettings)
    masking: Masking = field(default_factory=Masking)
    validation: Validation = field(default_factory=Validation)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        given = expand(yaml.safe_load(f) or {})
    parts = {"detection": Detection, "llm": Llm, "seed_map": SeedMapSettings, "masking": Masking, "validation": Validation}
    for name, kind in parts.items():
        given[name] = _known(kind, given.get(name))
    out = _known(Config, given)
    here = os.path.dirname(os.path.abspath(path))
    out.runs = os.path.normpath(os.path.join(here, out.runs))
    return out
