"""Parameters of a comparison and limits of ingestion."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    gst_min_match_length: int = 8
    minimum_comment_length: int = 12
    template_min_match: int = 10
    cluster_fragment: int = 6
    cluster_asymmetry: int = 4
    comment_floor: int = 35

    def __post_init__(self):
        if self.gst_min_match_length <= 0 or self.minimum_comment_length <= 0:
            raise ValueError("params must be positive")


@dataclass(frozen=True)
class Limits:
    max_depth: int = 8
    max_source_files: int = 2_000
    max_expanded_bytes: int = 52_428_800

    @classmethod
    def from_env(cls, env=os.environ, prefix: str = "TESSELLA_") -> Limits:
        """Positive integers from the environment, defaults for what is unset."""
        found = {}
        for f in fields(cls):
            if (raw := env.get(prefix + f.name.upper(), "").strip()):
                if not raw.isdigit() or int(raw) <= 0:
                    raise ValueError(f"{prefix}{f.name.upper()} must be a positive integer")
                found[f.name] = int(raw)
        return cls(**found)
