"""Settings by section, merged over defaults from a JSON file; unknown sections are dropped."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Retrieval:
    max_results: int = 5
    include_external: bool = True
    similarity_threshold: float | None = None


@dataclass(frozen=True)
class Privacy:
    filtering_level: str = "standard"
    use_synthetic: bool = True
    max_iterations: int = 3


@dataclass(frozen=True)
class Generation:
    max_length: int = 1024
    require_citations: bool = True
    check_hallucinations: bool = True


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    privacy: Privacy = field(default_factory=Privacy)
    generation: Generation = field(default_factory=Generation)


def load_config(path: str | None = None) -> Config:
    config = Config()
    if path is None:
        return config
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    for section in fields(config):
        known = {x.name for x in fields(getattr(config, section.name))}
        values = {k: v for k, v in given.get(section.name, {}).items() if k in known}
        config = replace(config, **{section.name: replace(getattr(config, section.name), **values)})
    return config
