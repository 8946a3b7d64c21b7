"""Fusion of rankings and hybrid recall."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import scoring
from strataloom.model import RecallQuery, Rejected, SearchOptions, created_ms, not_tombstoned
from strataloom.operators import graph, text, vector

RRF_K = 60
SEEDS = 5


def depth(k: int) -> int:
    """How far each ranking is read for k results."""
    return min(max(3 * k, 30), 50)


def fuse(legs: list[tuple[float, DataFrame]]) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, score): the sum of weight / (60 + rank). Each ranking is a
    top-k list, so its numbering in one task is bounded by its depth."""
    out = None
    for weight, leg in legs:
        ranked = leg.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
        part = ranked.select("id", (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def fuse_lists(legs: list[tuple[float, list[str]]]) -> list[tuple[str, float]]:
    """The same for lists on the driver."""
    total: dict[str, float] = {}
    for weight, ids in legs:
        for rank, x in enumerate(ids, 1):
            total[x] = total.get(x, 0.0) + weight / (RRF_K + rank)
    return sorted(total.items(), key=lambda r: (-r[1], r[0]))


def validate(q: RecallQuery) -> None:
    weights = (q.text_weight, q.vector_weight, q.graph_weight)
    if q.k < 1:
        raise Rejected("k must be positive")
    if not all(math.isfinite(w) and 0 <= w <= 10 for w in weights) or not any(weights):
        raise Rejected("leg weights must be 0 to 10 and not all 0")
    if not (math.isfinite(q.access_weight) and 0 <= q.access_weight <= 1):
        raise Rejected("the access weight must be 0 to 1")
    if q.labels is not None and not q.labels:
        raise Rejected("labels must not be empty")
    for name, w in q.label_weights.items():
        if not name or not (math.isfinite(w) and 0 <= w <= 10):
            raise Rejected("label weights need a name and a weight of 0 to 10")
    scoring.check_recency(q.recency_weight, q.half_life_ms)
    if q.vector is not None:
        vector.checked(q.vector)


def adjusted(ranked: DataFrame, nodes: DataFrame, counters: DataFrame | None, q: RecallQuery, now_ms: int) -> DataFrame:
    """Rankings (id, score) after the label filter, the tombstone and the factors of recency, access and
    label."""
    seen = nodes.select("id", "label", "props")
    out = ranked.join(seen, "id")
    if q.labels is not None:
        out = out.where(F.col("label").isin(q.labels))
    if q.tombstone:
        out = out.where(not_tombstoned(q.tombstone, now_ms))
    factor = F.lit(1.0)
    if q.recency_weight > 0:
        factor = factor * scoring.recency(created_ms(F.col("id")), now_ms, q.recency_weight, q.half_life_ms)
    if q.access_weight > 0 and counters is not None:
        out = out.join(counters, "id", "left")
        factor = factor * scoring.access(F.col("access_count"), q.access_weight)
    if q.label_weights:
        factor = factor * scoring.label(F.col("label"), q.label_weights)
    return out.select("id", (F.col("score") * factor).alias("score"))


def recall(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, index: text.TextIndex, q: RecallQuery,
           counters: DataFrame | None = None) -> DataFrame:
    """(id, score) of the best k nodes by text, vector and graph. A leg of weight 0 is not run. The graph
    leg spreads from the five best of the other two over their live neighbourhood."""
    validate(q)
    spark = nodes.sparkSession
    now = int(time.time() * 1000) if q.now_ms is None else q.now_ms
    wide, legs = depth(q.k), []
    if q.text_weight > 0:
        found = text.search(nodes, index, q.scopes, q.text, wide,
                            SearchOptions(fuzzy=q.fuzzy, stem=q.stem, now_ms=now), q.expansions)
        legs.append((q.text_weight, _held(spark, found)))
    if q.vector_weight > 0 and q.vector is not None and q.model is not None:
        legs.append((q.vector_weight, _held(spark, vector.search(nodes, vectors, q.scopes, q.model, q.vector, wide))))
    if not legs:
        return spark.createDataFrame([], "id string, score double")
    seeds = [(r.id, r.score) for r in fuse(legs).orderBy(F.desc("score"), "id").limit(SEEDS).collect()]
    if q.graph_weight > 0 and seeds:
        around = graph.traverse(nodes, edges, q.scopes, [x for x, _ in seeds], 1, now)
        ranks = graph.pagerank(around.nodes.select("id"), around.edges, seeds)
        legs.append((q.graph_weight, ranks.orderBy(F.desc("score"), "id").limit(wide)))
    return adjusted(fuse(legs), nodes, counters, q, now).orderBy(F.desc("score"), "id").limit(q.k)


def _held(spark, top: DataFrame) -> DataFrame:
    """A top list (50 rows at most) as a local table, so that later steps do not run its plan again."""
    return spark.createDataFrame([tuple(r) for r in top.select("id", "score").collect()], "id string, score double")
