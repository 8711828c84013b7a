"""Layered settings: defaults, experiment files, then ``a.b=value`` overrides."""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from typing import Any

from siftwell.functions.text import PLACEHOLDERS
from siftwell.sources.sinks import config_hash

SECTIONS = ("data", "preprocess", "folds", "retrievers", "fusion", "reranker", "ranking", "evaluation", "export")
DEFAULTS: dict[str, Any] = {
    "seed": 42,
    "data": {"articles": None, "labelled": None, "queries": None},
    "preprocess": {
        "html": {"parser": True, "drop_tags": ["script", "style", "input", "img", "svg", "button"]},
        "tokens": {"letters": r"\p{L}\p{N}", "min_length": 2, "stop_words": True, "placeholders": dict(PLACEHOLDERS)},
        "chunks": {"size": 400, "overlap": 100, "most": 40, "title_prefix": True},
    },
    "folds": {"n_splits": 5, "holdout": 0.2},
    "retrievers": {
        "bm25": {"enabled": True, "k1": 1.5, "b": 0.75, "title_weight": 2.0},
        "char": {"enabled": True, "low": 3, "high": 5, "min_df": 2, "sublinear": True, "title_weight": 2.0},
        "dense": {"enabled": False, "title_weight": 0.5, "dim": 64},
    },
    "fusion": {"method": "weighted_sum", "objective": "map", "rrf_k": 60, "candidates": 30, "samples": 500, "l2": 1.0, "ranks": True},
    "reranker": {"enabled": True, "backend": "lexical", "candidates": 30, "chunks": 4, "negatives": 7},
    "ranking": {"method": "lr", "grid": 51, "l2": 1.0, "graph": {"enabled": False, "top_m": 3, "conditional": True, "interaction": True}, "mlp": {"hidden": [16], "epochs": 300, "rate": 0.01, "decay": 0.03}},
    "evaluation": {"k": 10, "recall_ks": [10, 20, 30, 100], "resamples": 10000, "level": 0.95},
    "export": {"k": 10, "source": "blend"},
}


class ConfigError(ValueError):
    """Settings that cannot be used."""


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def override(config: dict[str, Any], item: str) -> dict[str, Any]:
    """``section.key=value``, the value read as YAML."""
    import yaml

    path, found, raw = item.partition("=")
    if not found:
        raise ConfigError(f"not key=value: {item}")
    tree: Any = yaml.safe_load(raw)
    for key in reversed(path.split(".")):
        tree = {key: tree}
    return merge(config, tree)


def load(files: Sequence[str] = (), overrides: Sequence[str] = (), base: Mapping[str, Any] | None = None) -> dict[str, Any]:
    import yaml

    config = copy.deepcopy(dict(base or DEFAULTS))
    for f in files:
        with open(f) as src:
            config = merge(config, yaml.safe_load(src) or {})
    for item in overrides:
        config = override(config, item)
    missing = [s for s in SECTIONS if s not in config]
    if missing:
        raise ConfigError(f"missing sections {missing}")
    return config


def section_hash(config: Mapping[str, Any], *sections: str) -> str:
    """A hash of the seed and the named sections: what a stage's results depend on."""
    return config_hash({"seed": config["seed"], **{s: config[s] for s in sections}})


def snapshot(config: Mapping[str, Any]) -> str:
    import yaml

    return yaml.safe_dump(dict(config), sort_keys=True, allow_unicode=True)
