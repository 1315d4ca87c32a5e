"""Settings: defaults, a YAML file, then the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "DOCLOOM__"


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 100
    context_size: int = 20
    chunk_overlap: int = 0
    context_overlap: int = 0
    ignore_sections: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.chunk_overlap or self.context_overlap:
            raise ValueError("overlap has to be 0: parents are put together from their chunks")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 50
    rerank_top_n: int = 10
    max_context_docs: int = 6
    bm25_weight: float = 1.0
    vector_weight: float = 1.0
    parent_window: int = 3
    return_parent: bool = True


@dataclass(frozen=True)
class Generation:
    context_budget_tokens: int = 6000
    max_candidate_chars: int = 4000
    attribution_threshold: float = 0.45


@dataclass(frozen=True)
class Ingest:
    max_file_mb: int = 100
    bulk_size: int = 200
    embed_batch: int = 32
    embed_chars: int = 8000


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    ingest: Ingest = field(default_factory=Ingest)


def coerce(raw: str) -> Any:
    """A bool, an int, a float or the text itself, the first that fits."""
    low = raw.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


def load(path: str | Path | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """PREFIX + SECTION__KEY of the environment goes over the file, the file over the defaults. Unknown sections and keys are errors."""
    data: dict[str, dict[str, Any]] = {}
    if path is not None:
        import yaml

        data = {k: dict(v or {}) for k, v in (yaml.safe_load(Path(path).read_text()) or {}).items()}
    for name, raw in env.items():
        if name.startswith(PREFIX):
            section, _, key = name[len(PREFIX) :].lower().partition("__")
            data.setdefault(section, {})[key] = coerce(raw)
    out = Settings()
    for section, values in data.items():
        held = getattr(out, section, None)
        if held is None or set(values) - {f.name for f in fields(held)}:
            raise ValueError(f"unknown settings in {section!r}: {sorted(values)}")
        out = replace(out, **{section: replace(held, **values)})
    return out


def snapshot(settings: Settings) -> dict[str, str]:
    """Flat text form, as an evaluation run keeps it."""
    return {f"{s}.{k}": str(v) for s, values in asdict(settings).items() for k, v in values.items()}
