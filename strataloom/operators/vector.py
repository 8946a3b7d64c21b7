"""Exact cosine search over embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.model import Rejected, ScopeSet


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length or they differ in dimension."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norms, F.lit(0.0)))


def checked(vector: list[float]) -> list[float]:
    if not vector or not all(math.isfinite(x) for x in vector):
        raise Rejected("a vector must be non-empty and finite")
    return [float(x) for x in vector]


def search(nodes: DataFrame, vectors: DataFrame, scopes: ScopeSet, model: str, query: list[float], k: int,
           candidates: DataFrame | None = None, floor: float | None = None) -> DataFrame:
    """(id, score) of the k nodes nearest to the query; equal scores by id. `candidates` (id) narrows it."""
    if k < 1:
        raise Rejected("k must be positive")
    query = checked(query)
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(x) for x in query])
    held = vectors.where((F.col("model") == model) & (F.size("vector") == len(query)))
    if candidates is not None:
        held = held.join(candidates.select("id").distinct(), "id", "left_semi")
    seen = nodes.where(scopes.admits(F.col("scope"))).select("id")
    scored = held.join(seen, "id", "left_semi").select(
        "id", (dot(F.col("vector"), q) / F.nullif(F.sqrt(dot(F.col("vector"), F.col("vector"))) * norm, F.lit(0.0))).alias("score"))
    scored = scored.where("score is not null")
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), "id").limit(k)


def similar_pairs(vectors: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """All pairs (u < v) of one model's vectors (id, vector) with a cosine of at least `least`. The rows
    are dealt to blocks; each pair of blocks is one task that multiplies two bounded matrices, so that no
    task holds more than two blocks."""
    import numpy as np
    import pandas as pd

    n = vectors.count()
    blocks = max(1, -(-n // block))
    dealt = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    # A row goes to every block pair that its block is in.
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = dealt.withColumn("o", F.explode(others)).select(
        F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "vector")

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        left, right = frame[frame["b"] == p], frame[frame["b"] == q]

        def unit(f):
            x = np.array(f["vector"].tolist(), float).reshape(len(f), -1)
            norms = np.sqrt((x * x).sum(axis=1))
            return x / np.where(norms > 0, norms, np.inf)[:, None]

        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "score": []}).astype({"u": str, "v": str, "score": float})
        score = unit(left) @ unit(right).T
        i, j = np.nonzero(score >= least)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if p == q else a != b
        lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        return pd.DataFrame({"u": lo, "v": hi, "score": score[i, j][keep]})

    return sent.groupBy("p", "q").applyInPandas(pairs, "u string, v string, score double")
