"""Bounded samples of labelled rows and small models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents outside the held-out fold, in the order of a hash of
    the id, so that the choice depends on nothing else. Repeated labels of one id, and equal texts, count once
    (with the larger label)."""
    chosen = labels.where(F.col(label).isin(0, 1) & (fold(modulus) != held_out) & F.col("doc_id").isNotNull()).groupBy(
        "doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("y").alias("y"))


def text_sample(documents: DataFrame, rows: int, *keep: str) -> DataFrame:
    """(text, *keep) of at most `rows` documents in the order of a hash of their id. Only ids are sorted;
    the texts are fetched by a join with the ids that were chosen, and never meet in one task."""
    chosen = documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows)
    return documents.select("doc_id", "text", *keep).join(F.broadcast(chosen), "doc_id").select("text", *keep)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method on standardised columns: (mean, scale, weights with
    the intercept last). One class alone gives its smoothed log-odds as intercept."""
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(rate / (1 - rate))
    if len(np.unique(y)) < 2:
        return mean, scale, w
    penalty = np.full(len(w), ridge * len(y) / 100)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
