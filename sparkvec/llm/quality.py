"""Operator 10: document quality by random Fourier features.

Statistics of the whole text are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel.  A ridge fit needs
only sums over rows: each partition of the training sample adds up its normal
equations, and the driver adds one matrix of fixed size a partition and solves.
Scores are calibrated by isotonic regression (pool adjacent violators) on
further folds, and interpolated between the pools, so they keep their order.

Labels are learnt from at most ``max_rows`` rows that are not held out, one for each
labelled id (of several rows, the one of the least text hash); every document is
scored in one pass without a shuffle, whole texts however long.  A null text is an
empty one, and an empty text has a score like any other.  Without labels the score
is 0.5, and a table without rows gives none.  Equal texts score alike; repeated rows
stay; other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm._util import STEP_BYTES, held_out, sampled
from sparkvec.llm._words import SPACED, no_straddle, sequence_hashes, steps, text_buffer, words

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000
#: Random Fourier features, width of the kernel in standard deviations a feature, ridge penalty a row.
FEATURES, WIDTH, RIDGE = 256, 1.5, 1e-4
THRESHOLD = 0.5
FOLDS = 5
#: Partitions whose normal equations the driver adds up.
SUMS = 16

_LINE = np.ones(256, dtype=bool)
_LINE[[0x0A, 0x0D]] = False
#: Byte classes: 0 other symbols, 1 A-Z, 2 a-z, 3 digits, 4 sentence punctuation, 5 white space, 6 not ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:'\"-()?!"]] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5
_CLASSES = 7


def _distinct(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many different hashes it has, and how often its commonest occurs."""
    different, most = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, text))
        t, s = text[order], h[order]
        at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])]))
        size = np.diff(np.append(at, len(s)))
        different += np.bincount(t[at], minlength=n)
        np.maximum.at(most, t[at], size)
    return different, most


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a buffer."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    w = words(data, bounds, SPACED, lower=False)
    of, count = w.text_of(), np.diff(w.first)
    h = w.hashes()
    different, most = _distinct(h, of, n)
    ok = no_straddle(w.first, len(h), 3)[: max(0, len(h) - 2)]
    triples = sequence_hashes(h, 3)[ok]
    triple_of = of[: len(ok)][ok]
    n_triples = np.bincount(triple_of, minlength=n)
    different_triples, _ = _distinct(triples, triple_of, n)
    lines = words(data, bounds, _LINE, lower=False)
    n_lines = np.diff(lines.first)
    different_lines, _ = _distinct(lines.hashes(), lines.text_of(), n)
    last = _CLASS[data[w.ends - 1]] if len(h) else np.zeros(0, np.int64)
    odd = np.bincount(of, weights=(last == 0), minlength=n)
    stop = np.bincount(of, weights=(last == 4), minlength=n)
    short = np.bincount(of, weights=((w.ends - w.starts) == 1), minlength=n)
    each, word, line = np.maximum(size, 1), np.maximum(count, 1), np.maximum(n_lines, 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(count),
            np.log1p(count / line),
            kinds / each[:, None],
            (w.ends - w.starts).astype(float).sum() and np.bincount(of, weights=w.ends - w.starts, minlength=n) / word,
            different / word,
            most / word,
            different_triples / np.maximum(n_triples, 1),
            different_lines / line,
            odd / word,
            stop / word,
            short / word,
        ]
    ) if len(h) else np.column_stack([np.log1p(size), np.zeros((n, 2)), kinds / each[:, None], np.zeros((n, 8))])


STATISTICS = 3 + _CLASSES + 8


def pool_adjacent(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: mean score and mean label of each pool, both increasing."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # label sum, score sum, rows
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, s, 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            for i, x in enumerate(pools.pop()):
                pools[-1][i] += x
    p = np.array(pools)
    return p[:, 1] / p[:, 2], p[:, 0] / p[:, 2]


@dataclass
class KernelModel:
    """Standardisation, random frequencies and phases, ridge weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.freq + self.phase) * np.sqrt(2 / self.freq.shape[1])
        return np.column_stack([np.ones(len(x)), wave])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        # Rounded, so that equal texts score alike wherever in a batch they stand.
        return np.round(np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1), 9)


def _sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(fold, y, x) of the labelled documents that are learnt from; at most ``max_rows`` distinct ids."""
    few = sampled(docs, labels, column, max_rows)
    few = few.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).alias("fold"), "y", F.col("text").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                x = statistics(*text_buffer(part.column("__text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("fold"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["fold", "y", "x"]
                )

    return few.mapInArrow(run, "fold long, y int, x array<double>").repartition(SUMS)


def _sums(sample: DataFrame, make, width: int) -> dict[int, np.ndarray]:
    """Per fold, the sum over rows of the matrix [features | y]' [features | y]; one matrix a partition is sent."""

    def run(batches):
        total = np.zeros((FOLDS, width, width))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            z = np.column_stack([make(x), y])
            for f in range(FOLDS):
                rows = z[fold == f]
                total[f] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((FOLDS, width, width))
    for row in sample.mapInArrow(run, "sums binary").toLocalIterator():
        total += np.frombuffer(row.sums, float).reshape(total.shape)
    return total


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = MAX_ROWS) -> KernelModel:
    """A model of ``labels.<column>`` from the statistics of docs (doc_id, text)."""
    sample = _sample(docs, labels, column, max_rows).persist()
    try:
        moments = _sums(sample, lambda x: np.column_stack([np.ones(len(x)), x]), STATISTICS + 2).sum(axis=0)
        rows = moments[0, 0]
        rng = np.random.default_rng(10)
        mean = moments[0, 1:-1] / max(rows, 1)
        var = np.diag(moments)[1:-1] / max(rows, 1) - mean**2
        scale = np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-12)), 1.0)
        none = np.zeros(0)
        model = KernelModel(
            mean, scale, rng.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS)), rng.uniform(0, 2 * np.pi, FEATURES), none, none, none
        )
        if not rows:
            return model
        sums = _sums(sample, model.features, FEATURES + 2)

        def solve(a: np.ndarray) -> np.ndarray:
            return np.linalg.solve(a[:-1, :-1] + (RIDGE * a[0, 0] + 1e-9) * np.eye(len(a) - 1), a[:-1, -1])

        folds = [solve(sums.sum(axis=0) - sums[f]) for f in range(FOLDS)]
        model.weights = solve(sums.sum(axis=0))

        def out_of_fold(batches):
            for batch in batches:
                x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
                z, fold = model.features(x), batch.column("fold").to_numpy(zero_copy_only=False)
                s = np.einsum("ij,ij->i", z, np.array(folds)[fold])
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("y")], names=["s", "y"])

        scored = sample.mapInArrow(out_of_fold, "s double, y int").toPandas()  # at most max_rows pairs of numbers
        model.knots, model.values = pool_adjacent(scored.s.to_numpy(), scored.y.to_numpy().astype(float))
        return model
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: KernelModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and ``score`` (0 to 1) of every row of docs (..., text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                s = shipped.value.score(statistics(*text_buffer(part.column("__text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], names=[*keep, "__score"])

    kept = slim.select(*keep).schema
    return slim.mapInArrow(run, T.StructType([*kept.fields, T.StructField("__score", T.DoubleType())])).withColumnRenamed("__score", "score")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels, "quality", max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept."""
    model = fit(docs, labels, "quality", max_rows)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return score(rows, model, keep=("__row",)).where(F.col("score") >= THRESHOLD).select("__row.*")
