"""Bounded samples of labelled rows, and logistic calibration of a few features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One in so many sampled rows calibrates; the others make the model.
CALIBRATING = 4


def held_out_of(doc_id: str, parts: int, part: int) -> Column:
    """Whether the hash of doc_id puts a row into the part that is never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part


def labelled_sample(labels: DataFrame, learn: Column | None, label: str, rows: int, doc_id: str = "doc_id") -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, label, calibrate) of at most `rows` documents of each class, and how many documents each class has.

    The smallest hashes of doc_id are taken, so a sample is repeatable and doesn't depend on the order of rows.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = []
    for value in (0, 1):
        taken += known.where(F.col("label") == value).orderBy("order", "doc_id").limit(rows).collect()
    local = [(r.doc_id, r.label, i % CALIBRATING == 0) for i, r in enumerate(taken)]
    schema = known.select("doc_id", "label").schema.add("calibrate", "boolean")
    return labels.sparkSession.createDataFrame(local, schema), (counts.get(0, 0), counts.get(1, 0))


def sampled_texts(documents: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label, calibrate) of a sample: one text for each doc_id, that with the least hash, however many rows share it."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label", "calibrate").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label", "calibrate")


def has_both_classes(rows: DataFrame) -> bool:
    """Whether a sample has texts of either class for the model and for its calibration."""
    return rows.select("calibrate", "label").distinct().count() == 4


@dataclass
class Calibration:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack((np.ones(len(features)), (features - self.mean) / self.scale))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, totals: tuple[int, int], ridge: float = 1.0, steps: int = 50) -> Calibration:
    """Logistic regression by Newton's method; classes weigh as they do among all labelled rows."""
    width = features.shape[1]
    if not len(features):
        return Calibration(np.zeros(width), np.ones(width), np.zeros(width + 1))
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(features)), (features - mean) / scale))
    y = labels.astype(float)
    share = y.mean()
    true = totals[1] / sum(totals)
    weight = np.where(y == 1, true / max(share, 1e-9), (1 - true) / max(1 - share, 1e-9))
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 10 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Calibration(mean, scale, w)
