"""What a collection is: its dimension, metric and index, checked once."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from sparkvec.functions.distance import check_metric

#: Parameters of each index type and their defaults.
INDEX_PARAMS = {
    "flat": {},
    "ivf": {"nlist": 100, "nprobe": 8, "seed": 42, "max_iter": 20},
    "hnsw": {"M": 16, "ef_construction": 200, "ef_search": 50, "seed": 42, "shard_rows": 50_000},
}


@dataclass(frozen=True)
class CollectionConfig:
    dim: int
    metric: str = "l2"
    index_type: str = "flat"
    index_params: dict = field(default_factory=dict)
    enable_wal: bool = False
    auto_checkpoint_threshold: int = 10_000
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def __post_init__(self):
        if not isinstance(self.dim, int) or self.dim <= 0:
            raise ValueError("dim must be a positive integer")
        check_metric(self.metric)
        if self.index_type not in INDEX_PARAMS:
            raise ValueError(f"unknown index_type {self.index_type!r}: expected one of {', '.join(INDEX_PARAMS)}")
        if unknown := set(self.index_params) - set(INDEX_PARAMS[self.index_type]):
            raise ValueError(f"unknown parameters of {self.index_type}: {', '.join(sorted(unknown))}")
        if self.index_type == "hnsw" and self.params["M"] < 2:
            raise ValueError("M must be at least 2")

    @property
    def params(self) -> dict:
        return INDEX_PARAMS[self.index_type] | self.index_params

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CollectionConfig:
        return cls(**json.loads(text))
