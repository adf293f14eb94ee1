"""Snapshots: versioned Parquet folders, a configuration, and a pointer to the current version.

A new version is written whole before the pointer moves, so a stopped writer
leaves the last snapshot as it was.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sparkvec.plans.config import CollectionConfig
from sparkvec.sources import files

ROWS = "vec_id long, embedding array<float>, metadata string"


def save(rows: DataFrame, path: str, config: CollectionConfig, offset: int = 0) -> None:
    """Write rows (vec_id, embedding, metadata) as the next version; offset: operations it includes."""
    spark = rows.sparkSession
    old = current(spark, path)
    version = (old["version"] if old else 0) + 1
    rows.select("vec_id", "embedding", "metadata").write.mode("overwrite").parquet(f"{path}/v{version:08d}")
    files.write_text(spark, f"{path}/config.json", config.to_json())
    files.write_text(spark, f"{path}/current.json", json.dumps({"version": version, "offset": offset}))
    for name in files.listing(spark, path):
        if name.startswith("v") and name < f"v{version:08d}":
            files.delete(spark, f"{path}/{name}")


def current(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(files.read_text(spark, f"{path}/current.json"))
    except FileNotFoundError:
        return None


def load(spark: SparkSession, path: str) -> tuple[CollectionConfig, DataFrame, int]:
    """(configuration, rows, offset) of the current version."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    config = CollectionConfig.from_json(files.read_text(spark, f"{path}/config.json"))
    return config, spark.read.schema(ROWS).parquet(f"{path}/v{at['version']:08d}"), at["offset"]


def read_npz(spark: SparkSession, vectors: str, metadata: str | None = None) -> DataFrame:
    """Rows of a local archive of arrays ``ids`` and ``vectors`` and a JSON object of metadata by id; an import for one machine's files."""
    with np.load(vectors) as arrays:
        ids, x = arrays["ids"].tolist(), arrays["vectors"].tolist()
    by_id = {}
    if metadata:
        with open(metadata) as file:
            by_id = json.load(file)
    return spark.createDataFrame([(i, v, json.dumps(by_id.get(str(i), {}))) for i, v in zip(ids, x, strict=True)], ROWS)
