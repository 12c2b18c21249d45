"""Settings: defaults, then a file, then the environment, then arguments."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Fixed values by default. Each can be set in a JSON file, as STRATAFORGE_<NAME>, or by argument."""

    max_pages: int = 1000
    max_depth: int = 3
    max_concurrency: int = 3
    abort_failure_rate: float = 0.5
    chunk_min: int = 500
    chunk_preferred: int = 1500
    chunk_max: int = 5000
    embedding_batch_texts: int = 100
    embedding_batch_chars: int = 50_000
    search_overfetch: int = 2
    search_text_weight: float = 1.0
    search_vector_weight: float = 1.0
    context_children: int = 3
    context_before: int = 1
    context_after: int = 2
    context_parents: int = 10
    cluster_gap: int = 3


def load(path: str | None = None, env: dict[str, str] | None = None, **arguments) -> Settings:
    """Unknown names are an error; values take the type of the default."""
    env = dict(os.environ) if env is None else env
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    found = json.loads(Path(path).read_text()) if path else {}
    found |= {n: env[f"STRATAFORGE_{n.upper()}"] for n in kinds if f"STRATAFORGE_{n.upper()}" in env}
    found |= {k: v for k, v in arguments.items() if v is not None}
    if unknown := set(found) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **{k: kinds[k](v) for k, v in found.items()})
