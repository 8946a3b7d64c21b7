"""Graph operators: bounded traversal as of an instant, personalised PageRank, link suggestion, order and
reachability of work graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.model import Rejected, ScopeSet, Subgraph, live_at, of_types

DAMPING, ROUNDS, TOLERANCE = 0.85, 30, 1e-9
#: Edges up to which PageRank runs on the driver.
DRIVER_EDGES = 200_000


def adjacency(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(near, far) beside each edge, in the direction that is walked."""
    if direction not in ("out", "in", "both"):
        raise Rejected(f"unknown direction {direction!r}")
    out = edges.withColumns({"near": F.col("src"), "far": F.col("dst")})
    into = edges.withColumns({"near": F.col("dst"), "far": F.col("src")})
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def reached(nodes: DataFrame, edges: DataFrame, scopes: ScopeSet, seeds: list[str], max_hops: int, as_of: int,
            edge_types: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(id, hop) of all nodes within `max_hops`, and the walkable edges with near and far.

    Each round joins once: rows on the frontier also send out their neighbours, and the least hop of an
    id wins, so the plan grows by one join a hop and never refers to the state twice."""
    if not 1 <= max_hops <= 4:
        raise Rejected("hops must be 1 to 4")
    seen = nodes.where(scopes.admits(F.col("scope"))).select("id")
    steps = adjacency(edges.where(scopes.admits(F.col("scope")) & of_types(edge_types) & live_at(as_of)), direction)
    state = seen.where(F.col("id").isin(seeds)).select("id", F.lit(0).alias("hop"))
    pairs = steps.select("near", "far")
    for hop in range(max_hops):
        grown = state.join(pairs, (state["id"] == pairs["near"]) & (state["hop"] == hop), "left").select(
            F.explode(F.array(F.struct("id", "hop"), F.struct(F.col("far").alias("id"), F.lit(hop + 1).alias("hop")))).alias("r")
        ).select("r.id", "r.hop").where("id is not null").groupBy("id").agg(F.min("hop").alias("hop"))
        state = grown.join(seen, "id", "left_semi")
    return state, steps


def traverse(nodes: DataFrame, edges: DataFrame, scopes: ScopeSet, seeds: list[str], max_hops: int, as_of: int,
             edge_types: list[str] | None = None, direction: str = "both") -> Subgraph:
    """Nodes within `max_hops` of the seeds, and every edge walked from a node that was expanded (one at
    fewer hops than the most). Seeds out of scope count for nothing."""
    state, steps = reached(nodes, edges, scopes, seeds, max_hops, as_of, edge_types, direction)
    expanded = state.where(F.col("hop") < max_hops).select(F.col("id").alias("near"))
    walked = steps.join(expanded, "near", "left_semi").join(state.select(F.col("id").alias("far")), "far", "left_semi")
    return Subgraph(nodes.join(state, "id"), walked.select(*edges.columns).dropDuplicates(["id"]))


# ---------------------------------------------------------------- PageRank


def pagerank_arrays(ids: list[str], pairs: list[tuple[str, str]], seeds: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Personalised PageRank of a small undirected simple graph; seeds are left out of the result."""
    at = {x: i for i, x in enumerate(sorted(ids))}
    weight = np.zeros(len(at))
    for x, w in seeds:
        if x in at and np.isfinite(w) and w > 0:
            weight[at[x]] += w
    if not weight.sum():
        return []
    links = sorted({(min(at[a], at[b]), max(at[a], at[b])) for a, b in pairs if a in at and b in at and a != b})
    u = np.array([p for p, _ in links] + [q for _, q in links], int)
    v = np.array([q for _, q in links] + [p for p, _ in links], int)
    degree = np.bincount(u, minlength=len(at)) if len(u) else np.zeros(len(at), int)
    home = weight / weight.sum()
    rank = home.copy()
    for _ in range(ROUNDS):
        share = np.where(degree > 0, rank / np.maximum(degree, 1), 0.0)
        flow = np.bincount(v, share[u], minlength=len(at)) if len(u) else np.zeros(len(at))
        lost = rank[degree == 0].sum()
        after = (1 - DAMPING) * home + DAMPING * (flow + lost * home)
        change = np.abs(after - rank).sum()
        rank = after
        if change < TOLERANCE:
            break
    named = {x for x, _ in seeds}
    scores = [(x, float(np.float32(rank[i]))) for x, i in at.items() if x not in named]
    return sorted(scores, key=lambda r: (-r[1], r[0]))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: list[tuple[str, float]], rounds: int = ROUNDS,
             driver_edges: int = DRIVER_EDGES, store=None) -> DataFrame:
    """(id, score) of all nodes but the seeds, best first. Small graphs (their size is checked) run on the
    driver; others as rounds of a join and an aggregate, each written by `store(df, label)` or
    checkpointed."""
    spark = nodes.sparkSession
    schema = "id string, score double"
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ids = nodes.select("id").distinct()
    if pairs.limit(driver_edges + 1).count() <= driver_edges and ids.limit(driver_edges + 1).count() <= driver_edges:
        found = pagerank_arrays([r.id for r in ids.collect()], [(r.a, r.b) for r in pairs.collect()], seeds)
        return spark.createDataFrame(found, schema)
    good: dict[str, float] = {}
    for x, w in seeds:
        if np.isfinite(w) and w > 0:
            good[x] = good.get(x, 0.0) + w
    weights = spark.createDataFrame(list(good.items()), "id string, w double").join(ids, "id", "left_semi")
    total = weights.agg(F.sum("w")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    cut = (lambda df, label: store(df, label)) if store else (lambda df, label: df.checkpoint())
    links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))).join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(
        ids.select(F.col("id").alias("v")), "v", "left_semi")
    links = cut(links, "links")
    degree = links.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    state = cut(ids.join(weights, "id", "left").join(degree, F.col("id") == F.col("u"), "left").select(
        "id", F.coalesce(F.col("w") / total, F.lit(0.0)).alias("home"), F.coalesce("d", F.lit(0)).alias("d"),
        F.coalesce(F.col("w") / total, F.lit(0.0)).alias("rank")), "rank")
    for _ in range(rounds):
        lost = state.where("d = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        flow = links.join(state.where("d > 0").select(F.col("id").alias("u"), (F.col("rank") / F.col("d")).alias("x")), "u").groupBy(
            "v").agg(F.sum("x").alias("x"))
        after = cut(state.join(flow, F.col("id") == F.col("v"), "left").select(
            "id", "home", "d", ((1 - DAMPING) * F.col("home") + DAMPING * (F.coalesce("x", F.lit(0.0)) + lost * F.col("home"))).alias("rank"),
            F.col("rank").alias("was")), "rank")
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        state = after.drop("was")
        if change < TOLERANCE:
            break
    return state.where(~F.col("id").isin([x for x, _ in seeds])).select(
        "id", F.col("rank").cast("float").cast("double").alias("score")).orderBy(F.desc("score"), "id")


# ---------------------------------------------------------------- links


def neighbours(edges: DataFrame, scopes: ScopeSet, as_of: int) -> DataFrame:
    """Distinct live (near, far) pairs in both directions."""
    live = edges.where(scopes.admits(F.col("scope")) & live_at(as_of))
    return adjacency(live).where("near <> far").select("near", "far").distinct()


def common_neighbours(edges: DataFrame, scopes: ScopeSet, target: str, as_of: int) -> DataFrame:
    """(id, neighbour) for each node two steps from the target and each neighbour they share."""
    pairs = neighbours(edges, scopes, as_of)
    own = pairs.where(F.col("near") == target).select(F.col("far").alias("neighbour"))
    return pairs.where((F.col("near") != target)).join(own, F.col("far") == F.col("neighbour")).select(
        F.col("near").alias("id"), "neighbour")


def suggest_links(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, scopes: ScopeSet, target: str, k: int, as_of: int,
                  model: str | None = None, floor: float | None = None) -> DataFrame:
    """Nodes worth a link to the target: (id, score, common_neighbors, similarity). Rankings by PageRank
    over three hops and by vectors are fused; the target and what it is linked to are left out."""
    from strataloom.operators.recall import depth, fuse
    from strataloom.operators.vector import search

    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "id string, score double, common_neighbors array<string>, similarity double")
    if k < 1:
        raise Rejected("k must be positive")
    if nodes.where(scopes.admits(F.col("scope")) & (F.col("id") == target)).isEmpty():
        return empty
    pairs = neighbours(edges, scopes, as_of)
    excluded = pairs.where(F.col("near") == target).select(F.col("far").alias("id"))
    wide = depth(k)
    around = traverse(nodes, edges, scopes, [target], 3, as_of)
    ranks = pagerank(around.nodes.select("id"), around.edges, [(target, 1.0)]).join(excluded, "id", "left_anti").orderBy(
        F.desc("score"), "id").limit(wide)
    legs, similar = [(1.0, ranks)], None
    own = vectors.where(F.col("id") == target)
    if model is not None:
        own = own.where(F.col("model") == model)
    row = own.first()
    if row is not None:
        more = excluded.count() + 1
        similar = search(nodes, vectors, scopes, row["model"], list(row["vector"]), wide + more, floor=floor).where(
            F.col("id") != target).join(excluded, "id", "left_anti").orderBy(F.desc("score"), "id").limit(wide)
        legs.append((1.0, similar))
    best = fuse(legs).orderBy(F.desc("score"), "id").limit(k)
    shared = common_neighbours(edges, scopes, target, as_of).groupBy("id").agg(F.array_sort(F.collect_set("neighbour")).alias("common_neighbors"))
    out = best.join(shared, "id", "left")
    similarity = similar.select("id", F.col("score").alias("similarity")) if similar is not None else None
    out = out.join(similarity, "id", "left") if similarity is not None else out.withColumn("similarity", F.lit(None).cast("double"))
    return out.select("id", "score", F.coalesce("common_neighbors", F.array().cast("array<string>")).alias("common_neighbors"),
                      "similarity").orderBy(F.desc("score"), "id")


def display_names(nodes: DataFrame) -> DataFrame:
    """(id, label, name): the name property, or the first 80 characters of the content."""
    name, content = F.col("props")["name"]["s"], F.col("props")["content"]["s"]
    short = F.when(F.char_length(content) > 80, F.concat(F.substring(content, 1, 80), F.lit("…"))).otherwise(content)
    return nodes.select("id", "label", F.coalesce(name, short).alias("name"))
