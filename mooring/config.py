"""Run settings: four frozen sections, read from YAML and checked."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

# The names that settings may have, here, and their defaults, in the sections below.
VARIANTS = ("top_rho", "sample_only", "sample_full_validation", "sample_full_validation_refine", "sample_full_validation_refine_cell_renderer", "adaptive_k")
RENDERERS = ("old", "anchor_only", "nearest", "cell_top_rho", "global_top_rho")
MODES = ("current", "title_aware", "diagnostic_subject_title")
METRICS = ("angular", "cosine")


@dataclass(frozen=True)
class Experiment:
    name: str = "retrieval"
    seed: int = 42
    limit_queries: int | None = None


@dataclass(frozen=True)
class Universe:
    max_nodes: int = 600
    min_relevance_mass: float = 0.98
    anchor_node_types: tuple[str, ...] = ("chunk", "sentence")


@dataclass(frozen=True)
class Distance:
    metric: str = "angular"


@dataclass(frozen=True)
class Search:
    """The section ``search``; in files it may have another name, see parse_config."""

    retrieval_variant: str = "sample_full_validation_refine"
    renderer: str = "old"
    relevance_mode: str = "current"
    k: int = 3
    k_max: int = 4
    auto_k: bool = False
    lambda_k: float = 0.0
    num_samples: int = 5
    sample_size_per_k: int = 12
    sample_size_cap: int = 48
    sample_uniform_mix: float = 0.15
    require_exact_sample_search: bool = True
    max_exact_combinations: int = 1_000_000
    refinement_iters: int = 1
    renderer_gamma: float = 0.0
    token_weight: float = 0.03
    anchor_penalty: float = 0.0
    max_context_tokens: int = 1200
    max_context_nodes: int | None = None
    strict_context_budget: bool = False
    evidence_per_anchor: int = 2


@dataclass(frozen=True)
class Config:
    experiment: Experiment = field(default_factory=Experiment)
    universe: Universe = field(default_factory=Universe)
    distance: Distance = field(default_factory=Distance)
    search: Search = field(default_factory=Search)

    @property
    def renderer(self) -> str:
        """The renderer in effect: some variants fix it."""
        fixed = {"sample_full_validation_refine_cell_renderer": "cell_top_rho", "top_rho": "global_top_rho"}
        return fixed.get(self.search.retrieval_variant, self.search.renderer)

    def with_search(self, **values: Any) -> "Config":
        return checked(replace(self, search=replace(self.search, **values)))


#: Section names in files, as users write them.
SECTIONS = {"experiment": Experiment, "universe": Universe, "distance": Distance, "search": Search}


def parse_config(raw: dict[str, Any] | None) -> Config:
    """A mapping of sections as a Config.  Missing and null sections are defaults; unknown
    sections and keys are errors, but for one section of search settings under another name,
    as older files have it: it counts as ``search`` if that isn't there."""
    raw = raw or {}
    if not isinstance(raw, dict):
        raise ValueError("a configuration is a mapping of sections")
    known = {f.name for f in fields(Search)}
    named = [k for k, v in raw.items() if k not in SECTIONS and isinstance(v, dict) and v and set(v) <= known]
    if len(named) == 1 and "search" not in raw:
        warnings.warn(f"section {named[0]!r} is taken as 'search'", stacklevel=2)
        raw = {"search" if k == named[0] else k: v for k, v in raw.items()}
    if unknown := sorted(set(raw) - set(SECTIONS)):
        raise ValueError(f"unknown sections: {unknown}")
    made = {}
    for name, cls in SECTIONS.items():
        values = raw.get(name) or {}
        if not isinstance(values, dict):
            raise TypeError(f"section {name!r} must be a mapping")
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown keys in {name}: {unknown}")
        if "anchor_node_types" in values:
            values = values | {"anchor_node_types": tuple(values["anchor_node_types"])}
        made[name] = cls(**values)
    return checked(Config(**made))


def load_config(path: str | Path) -> Config:
    import yaml

    return parse_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def checked(c: Config) -> Config:
    """``c`` itself, if its values are allowed."""
    s, u = c.search, c.universe
    rules = [
        (s.retrieval_variant in VARIANTS, f"retrieval_variant must be one of {VARIANTS}"),
        (s.renderer in RENDERERS, f"renderer must be one of {RENDERERS}"),
        (s.relevance_mode in MODES, f"relevance_mode must be one of {MODES}"),
        (c.distance.metric in METRICS, f"metric must be one of {METRICS}"),
        (min(s.k, s.k_max, s.num_samples, s.sample_size_per_k, s.sample_size_cap, s.max_exact_combinations, s.max_context_tokens, u.max_nodes) >= 1,
         "k, k_max, sample numbers and sizes, and caps must be positive"),
        (min(s.lambda_k, s.renderer_gamma, s.token_weight, s.anchor_penalty, s.evidence_per_anchor, s.refinement_iters, s.max_context_nodes or 0) >= 0,
         "weights, penalties, iterations and max_context_nodes must not be negative"),
        (0 <= s.sample_uniform_mix <= 1, "sample_uniform_mix must be in [0, 1]"),
        (0 < u.min_relevance_mass <= 1, "min_relevance_mass must be in (0, 1]"),
        (c.experiment.limit_queries is None or c.experiment.limit_queries >= 1, "limit_queries must be at least 1 or null"),
    ]
    for ok, message in rules:
        if not ok:
            raise ValueError(message)
    if s.max_context_nodes and s.max_context_nodes < s.k:
        message = "max_context_nodes is smaller than k, so anchors may exceed the node budget"
        if s.strict_context_budget:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return c
