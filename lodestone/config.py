"""Parameters with their defaults, one dataclass per part of the engine."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Retrieval:
    top_k_dense: int = 100
    top_k_sparse: int = 100
    top_k_final: int = 10
    fusion_method: str = "rrf"
    rrf_k: int = 60
    lambda_dense: float = 0.5
    lambda_sparse: float = 0.5
    top_k_final_parallel: int | None = 80
    top_k_final_seq1: int | None = 30
    top_k_final_seq2: int | None = 60
    fallback_chunks: int = 12
    fallback_chars: int = 2000
    followup_docs: int = 2
    followup_chunks: int = 3
    followup_chars: int = 600

    def parallel(self) -> int:
        return self.top_k_final_parallel or 2 * self.top_k_final

    def first_pass(self) -> int:
        return self.top_k_final_seq1 or max(10, self.top_k_final // 2)

    def second_pass(self) -> int:
        return self.top_k_final_seq2 or self.top_k_final


@dataclass(frozen=True)
class Graph:
    entity_type_labels: tuple[str, ...] = ("PERSON", "LOCATION", "OTHER")
    texts_per_proposition: int = 10
    type_context_chars: int = 220
    alpha_core: float = 0.5
    alpha_betw: float = 0.5
    betweenness_pivots: int | None = None  # sources of the estimate; None: all of them


@dataclass(frozen=True)
class Ranking:
    gamma_sem: float = 0.5
    beta_struct: float = 1.0
    k_prop: int = 12
    k_ent: int = 12
    top_anchor_p: int = 8
    top_entity_expand: int = 6
    max_final_p: int = 18
    max_chunks_per_p: int = 3
    expand_decay: float = 0.8
    expand_struct_mix: float = 0.3
    score_text_chars: int = 420


@dataclass(frozen=True)
class Evidence:
    k_p: int = 3
    k_e: int = 5
    k_c: int = 5
    k_z: int = 2
    max_len_prop: int = 520
    max_len_chunk: int = 650
    max_len_ent: int = 120
    max_len_type: int = 40


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    graph: Graph = field(default_factory=Graph)
    ranking: Ranking = field(default_factory=Ranking)
    evidence: Evidence = field(default_factory=Evidence)


def clean_labels(labels: list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """Stripped, upper-cased, distinct and sorted type labels; none at all is an error."""
    out = tuple(sorted({x.strip().upper() for x in labels if x and x.strip()}))
    if not out:
        raise ValueError("entity_type_labels is empty")
    return out


def from_mapping(data: Any) -> Config:
    """A configuration from nested mappings; unknown keys are errors, absent ones default."""
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    parts = {}
    for f in dataclasses.fields(Config):
        own = dict(data.get(f.name) or {})
        kind = f.default_factory
        known = {x.name for x in dataclasses.fields(kind)}
        if unknown := set(own) - known:
            raise ValueError(f"unknown keys in {f.name}: {', '.join(sorted(unknown))}")
        if "entity_type_labels" in own:
            own["entity_type_labels"] = clean_labels(own["entity_type_labels"])
        parts[f.name] = kind(**own)
    if unknown := set(data) - {f.name for f in dataclasses.fields(Config)}:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    return Config(**parts)


def load_config(path: str) -> Config:
    """Read YAML (where PyYAML is installed) or JSON."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:
        return from_mapping(json.loads(text))
    return from_mapping(yaml.safe_load(text))
