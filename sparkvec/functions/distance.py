"""Vector distances as columns; smaller is closer.

l2 is squared, ip is negated, cosine is 1 - similarity and 1.0 for a zero vector.
All arithmetic is in double, whatever the stored type.  Vectors of different lengths,
and null ones, have a null distance; searches leave their rows out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "ip")
#: Dimensions up to which a distance to a given vector is one arithmetic expression.
UNROLL = 256


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: expected one of {', '.join(METRICS)}")
    return metric


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of two array columns."""
    check_metric(metric)
    alike = F.size(a) == F.size(b)
    if metric == "l2":
        return F.when(alike, _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))
    if metric == "ip":
        return F.when(alike, -dot(a, b))
    both = norm(a) * norm(b)
    return F.when(alike, F.when(both > 0, 1 - dot(a, b) / both).otherwise(1.0))


def distance_to(metric: str, column: Column, vector: Sequence[float]) -> Column:
    """Distance of an array column to one given vector.

    Up to ``UNROLL`` dimensions this is plain arithmetic over elements, which stays
    inside generated code; longer vectors take the higher-order form.
    """
    check_metric(metric)
    q = [float(np.float32(x)) for x in vector]
    if len(q) > UNROLL or not q:
        return distance(metric, column, F.array(*[F.lit(x) for x in q]) if q else F.array().cast("array<double>"))
    x = [column[i].cast("double") for i in range(len(q))]  # looked at in rows of this length only
    add = lambda terms: reduce(lambda s, t: s + t, terms)
    alike = F.size(column) == len(q)
    if metric == "l2":
        return F.when(alike, add([(c - v) * (c - v) for c, v in zip(x, q, strict=True)]))
    product = add([c * v for c, v in zip(x, q, strict=True)])
    if metric == "ip":
        return F.when(alike, -product)
    both = F.sqrt(add([c * c for c in x])) * float(np.sqrt(sum(v * v for v in q)))
    return F.when(alike, F.when(both > 0, 1 - product / both).otherwise(1.0))


def similarity(dist: Column, clamp: bool = False) -> Column:
    """1 - distance, for cosine; clamped at 0 if asked."""
    return F.greatest(F.lit(0.0), 1 - dist) if clamp else 1 - dist


def pairwise(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(queries, rows) distances by matrix products, for blocks inside a task."""
    check_metric(metric)
    q, x = np.asarray(queries, np.float64), np.asarray(rows, np.float64)
    product = q @ x.T
    if metric == "ip":
        return -product
    q2, x2 = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
    if metric == "l2":
        return np.maximum(q2 + x2 - 2 * product, 0)
    both = np.sqrt(q2 * x2)
    return np.where(both > 0, 1 - product / np.where(both > 0, both, 1), 1.0)


def paired(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to the same row of b, by the exact formula."""
    check_metric(metric)
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if metric == "l2":
        return ((a - b) ** 2).sum(axis=-1)
    product = (a * b).sum(axis=-1)
    if metric == "ip":
        return -product
    both = np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))
    return np.where(both > 0, 1 - product / np.where(both > 0, both, 1), 1.0)
