"""Named collections below one folder."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from sparkvec.plans.collection import Collection
from sparkvec.plans.config import CollectionConfig
from sparkvec.sources import files

_NAME = re.compile(r"[A-Za-z0-9_-]+")


class Catalog:
    """Collections by name; what is durable is reopened from its files."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir
        self.open: dict[str, Collection] = {}
        path = f"{data_dir}/collections.json"
        configs = json.loads(files.read_text(spark, path)) if files.exists(spark, path) else {}
        for name, config in configs.items():
            self.open[name] = Collection(spark, CollectionConfig(**config), f"{data_dir}/{name}")

    def _save(self) -> None:
        files.write_text(self.spark, f"{self.data_dir}/collections.json", json.dumps({n: json.loads(c.config.to_json()) for n, c in self.open.items()}))

    def create(self, name: str, config: CollectionConfig) -> Collection:
        if not _NAME.fullmatch(name):
            raise ValueError("a collection's name has letters, digits, - and _ only")
        if name in self.open:
            raise ValueError(f"collection {name!r} exists")
        self.open[name] = Collection(self.spark, config, f"{self.data_dir}/{name}")
        self._save()
        return self.open[name]

    def get(self, name: str) -> Collection:
        if name not in self.open:
            raise KeyError(f"no collection {name!r}")
        return self.open[name]

    def delete(self, name: str) -> None:
        self.get(name).close()
        del self.open[name]
        self._save()
        files.delete(self.spark, f"{self.data_dir}/{name}")

    def list(self) -> list[dict]:
        return [{"name": n, **c.stats()} for n, c in sorted(self.open.items())]

    def close(self) -> None:
        for c in self.open.values():
            c.close()
