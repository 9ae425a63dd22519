"""Engine settings: defaults, then a JSON file, then environment variables; and the stages of the ablation ladder."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

FLAGS_ON = ("views", "exact", "datenum", "entity", "rerank", "rrf", "dedup", "use_options", "supersession", "supersession_update_guard")
FLAGS_OFF = ("temporal_intent", "exact_scan", "vector", "pair_top20_protect", "pair_exact_protect", "pair_rerank", "semantic_rerank", "preference_role_boost")
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def default_flags() -> dict[str, bool]:
    return dict.fromkeys(FLAGS_ON, True) | dict.fromkeys(FLAGS_OFF, False)


@dataclass(frozen=True)
class Config:
    window_size: int = 3
    window_overlap: int = 1
    segment_max_messages: int = 12
    segment_max_gap_seconds: int = 1800
    top_k_default: int = 10
    top_k_max: int = 100
    max_candidates: int = 400
    max_query_tokens: int = 64
    feature_scan_limit: int = 5000
    dense_max_candidates: int = 400
    message_slot_ratio: float = 0.5
    rrf_k: int = 60
    rrf_weight_feature: float = 1.0
    rrf_weight_lexical: float = 0.1
    rrf_weight_dense: float = 0.1
    dense_dimension: int = 256
    pair_pool: int = 100
    pair_mode: str = "model"
    pair_weight: float = 0.25
    pair_k: float = 60.0
    semantic_pool: int = 100
    semantic_boundary: int = 20
    semantic_exact_quota: int = 3
    recency_weight: float = 8.0
    recency_weight_intent: float = 12.0
    supersession_weight: float = 4.0
    supersession_penalty: float = 1.0
    supersession_min_overlap: float = 0.5
    supersession_max_pairs: int = 40
    preference_role_weight: float = 14.0
    retention_days: int = 30
    #: Statistics of lexical recall over all users or over the query's user.
    stats_scope: str = "global"
    flags: dict[str, bool] = field(default_factory=default_flags)

    def on(self, flag: str) -> bool:
        return self.flags[flag]

    def with_flags(self, **changes: bool) -> Config:
        if unknown := changes.keys() - default_flags().keys():
            raise ValueError(f"unknown flags: {sorted(unknown)}")
        return dataclasses.replace(self, flags=self.flags | changes)

    def merge(self, values: dict) -> Config:
        values = dict(values)
        flags = values.pop("flags", {})
        if unknown := values.keys() - {f.name for f in dataclasses.fields(self)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return dataclasses.replace(self, **values).with_flags(**flags).validate()

    def validate(self) -> Config:
        least_one = ("window_size", "segment_max_messages", "top_k_default", "top_k_max", "max_candidates", "max_query_tokens", "feature_scan_limit", "dense_max_candidates", "rrf_k", "dense_dimension", "pair_pool", "semantic_pool")
        for name in least_one:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 <= self.window_overlap < self.window_size:
            raise ValueError("window_overlap must be at least 0 and less than window_size")
        if not 0 <= self.message_slot_ratio <= 1:
            raise ValueError("message_slot_ratio must be between 0 and 1")
        if self.pair_mode not in ("model", "rrf", "cc"):
            raise ValueError("pair_mode must be model, rrf or cc")
        if self.stats_scope not in ("global", "user"):
            raise ValueError("stats_scope must be global or user")
        if self.on("pair_rerank") and self.on("semantic_rerank"):
            raise ValueError("pair_rerank and semantic_rerank exclude each other")
        return self

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "TESSERA_") -> Config:
        """Defaults < JSON file < environment (PREFIX + NAME, PREFIX + FLAG_ + NAME)."""
        values: dict = {}
        if path:
            with open(path) as f:
                values = json.load(f)
        flags = dict(values.pop("flags", {}))
        env = os.environ if env is None else env
        for f in dataclasses.fields(cls):
            if f.name != "flags" and (raw := env.get(prefix + f.name.upper())) is not None:
                values[f.name] = {"int": int, "float": float, "str": str}[f.type](raw)
        for name in default_flags():
            if (raw := env.get(f"{prefix}FLAG_{name.upper()}")) is not None:
                if raw.lower() not in TRUE + FALSE:
                    raise ValueError(f"{prefix}FLAG_{name.upper()} must be true or false")
                flags[name] = raw.lower() in TRUE
        return cls().merge(values | {"flags": flags})


#: Flags that each stage adds to the one that it builds on.
_STEPS = {
    "L0": (None, ["use_options"]), "L1": ("L0", ["views"]), "L2": ("L1", ["exact"]), "L3": ("L2", ["datenum", "entity", "rerank"]), "L4": ("L3", ["dedup"]), "L5": ("L4", ["rrf"]),
    "L6": ("L5", ["temporal_intent"]), "L7": ("L5", ["vector"]), "L8": ("L5", ["supersession"]), "L9": ("L8", ["supersession_update_guard"]), "L10": ("L9", ["preference_role_boost"]),
}


def stage(name: str, base: Config | None = None) -> Config:
    """The settings of an ablation stage: all flags off but those of the stage and of what it builds on."""
    on: set[str] = set()
    at: str | None = name
    while at:
        at, own = _STEPS[at]
        on |= set(own)
    return (base or Config()).with_flags(**{f: f in on for f in default_flags()})


STAGES = tuple(_STEPS)
