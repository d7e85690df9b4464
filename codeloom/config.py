"""Settings of an index: flags before environment before file before defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

#: Prefix of environment variables, e.g. CODELOOM_TOP_K.
PREFIX = "CODELOOM_"


@dataclass(frozen=True)
class Config:
    """What can be set; every field has a type that values from elsewhere are turned into."""

    embeddings: bool = False
    symbol_graph: bool = True
    git_signals: bool = True
    git_rank_boost: float = 0.0
    top_k: int = 5
    min_score: float = 0.3
    taint_depth: int = 4
    resolver: str = "heuristic"

    def settings(self) -> dict[str, str]:
        """As settings of a Spark session, under spark.codeloom."""
        return {f"spark.codeloom.{k}": str(v).lower() if isinstance(v, bool) else str(v) for k, v in asdict(self).items()}


def _typed(kind: str, value: object) -> object:
    if kind == "bool":
        return str(value).strip().lower() in ("1", "true", "on", "yes")
    return {"int": int, "float": float, "str": str}[kind](value)


def resolve_config(flags: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None, file: str | None = None) -> Config:
    """The first of flags, environment (PREFIX and the name in upper case), a JSON file, and the default that has a setting.

    Values that don't fit their type, unknown settings and an unreadable file are passed over.
    """
    try:
        with open(file or "") as f:
            stored = json.load(f)
    except (OSError, ValueError):
        stored = {}
    layers = (flags or {}, {k[len(PREFIX) :].lower(): v for k, v in (environment or {}).items() if k.startswith(PREFIX)}, stored if isinstance(stored, dict) else {})
    found: dict[str, object] = {}
    for f in fields(Config):
        for layer in layers:
            if layer.get(f.name) is not None:
                try:
                    found[f.name] = _typed(str(f.type), layer[f.name])
                    break
                except (TypeError, ValueError):
                    continue
    return Config(**found)
