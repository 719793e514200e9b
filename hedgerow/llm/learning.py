"""Small learners, and the labelled rows, all or a bounded sample of them, to fit them on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int, usable) -> tuple[DataFrame, float]:
    """Up to ``rows`` / 2 documents of either label as (id, text, y), and the share of label 1 among all usable labels.

    ``usable`` is a condition on the labels' id. Which rows are taken depends on a hash of their id only; repeated
    labels of an id count as their largest, repeated texts once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & usable).groupBy(F.col(id).alias("id")).agg(
        F.max(F.col(label)).cast("int").alias("y"))
    ones, all_ = known.agg(F.sum("y"), F.count("*")).first()
    half = rows // 2
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(half)
        picked = some if picked is None else picked.unionByName(some)
    joined = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "id")
    sample = joined.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min_by(F.struct("id", "text"), "id").alias("s")).select(
        "s.id", "s.text", "y")
    return sample, (ones or 0) / all_ if all_ else 0.0


def labelled_hashes(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, usable) -> tuple[DataFrame, float]:
    """(h, y) for every text with a usable label, once each, and the share of label 1 among all usable labels.

    ``h`` is the text's xxhash64, so no text is moved to its label: what is made of a text is joined to its mark instead.
    ``usable`` is a condition on the labels' id; repeated labels of an id count as their largest, repeated texts once.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & usable).groupBy(F.col(id).alias("id")).agg(
        F.max(F.col(label)).cast("int").alias("y"))
    ones, all_ = known.agg(F.sum("y"), F.count("*")).first()
    hashed = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    return hashed.join(known, "id").select("h", "y").distinct(), (ones or 0) / all_ if all_ else 0.0


def logistic_rows(rows: DataFrame, width: int, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """``logistic`` over a table (x array of ``width`` doubles, y): gradient and curvature are summed by Spark, step by step."""
    size = width + 1

    def summed(w):
        def run(batches):
            gradient, curve = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
                z = np.column_stack([x, np.ones(len(x))])
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                gradient += z.T @ (batch.column(1).to_numpy() - p)
                curve += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
            values = np.concatenate([gradient, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["k", "v"])

        # decimals, so that the order of the partial sums does not show
        sums = rows.select("x", "y").mapInArrow(run, "k int, v double").groupBy("k").agg(
            F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v"))
        values = np.zeros(size + size * size)
        for r in sums.collect():  # as many rows as there are coefficients and pairs of them
            values[r.k] = r.v
        return values[:size], values[size:].reshape(size, size)

    w, penalty = np.zeros(size), ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        gradient, curve = summed(w)
        step = np.linalg.solve(curve + penalty, gradient - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the last one is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def shifted(intercept: float, sample_share: float, true_share: float) -> float:
    """The intercept for the true share of label 1, learnt on a sample with another share."""
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    return float(intercept + logit(true_share) - logit(sample_share))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
