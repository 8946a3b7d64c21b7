"""State from the op log: each table is one declarative fold over the operations.

All folds are "since the last RemoveNode of this id": an id can come back after a removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _removals(ops: DataFrame) -> DataFrame:
    return ops.where("op = 'RemoveNode'").groupBy("id").agg(F.max("seq").alias("removed"))


def nodes(ops: DataFrame) -> DataFrame:
    """Live nodes (id, scope, label, props). A property is the last write of its key; a deleted key is
    gone. One shuffle: the ops of an id meet in one aggregate."""
    writes = ops.where("op in ('CreateNode', 'SetNodeProps', 'RemoveNode')").select(
        "id", "seq", "op", "scope", "label", "props", "del_keys")
    alive = writes.groupBy("id").agg(
        F.max(F.when(F.col("op") == "RemoveNode", F.col("seq"))).alias("removed"),
        F.max_by(F.struct("seq", "scope", "label"), F.when(F.col("op") == "CreateNode", F.col("seq"))).alias("made"),
    ).where(F.col("made").isNotNull() & (F.col("removed").isNull() | (F.col("made.seq") > F.col("removed"))))
    born = alive.select("id", F.col("made.seq").alias("born"), F.col("made.scope").alias("scope"), F.col("made.label").alias("label"))
    changes = writes.where("op <> 'RemoveNode'").select(
        "id", "seq", F.explode(F.concat(
            F.transform(F.map_entries(F.coalesce("props", F.expr("map()").cast("map<string,struct<t:string,s:string,i:bigint,f:double,b:boolean,y:binary>>"))),
                        lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))),
            F.transform(F.coalesce("del_keys", F.array().cast("array<string>")),
                        lambda k: F.struct(k.alias("k"), F.lit(None).cast("struct<t:string,s:string,i:bigint,f:double,b:boolean,y:binary>").alias("v"))))
        ).alias("c"))
    last = changes.join(born.select("id", "born"), "id").where("seq >= born").groupBy("id", F.col("c.k").alias("k")).agg(
        F.max_by(F.struct(F.col("c.v").alias("v")), "seq").alias("w")).where("w.v is not null")
    props = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("w.v").alias("v"))))).alias("props"))
    empty = F.expr("map()").cast("map<string,struct<t:string,s:string,i:bigint,f:double,b:boolean,y:binary>>")
    return born.join(props, "id", "left").select("id", "scope", "label", F.coalesce("props", empty).alias("props"))


def edges(ops: DataFrame) -> DataFrame:
    """Edges, open and closed. An edge goes with either endpoint: a removal after the edge was made drops
    it. The first CloseEdge dates its end."""
    made = ops.where("op = 'CreateEdge'").select("id", "seq", "scope", "ty", "src", "dst", "props", "valid_from")
    closed = ops.where("op = 'CloseEdge'").groupBy("id").agg(F.min_by("valid_to", "seq").alias("valid_to"))
    gone = _removals(ops)
    kept = made
    for end in ("src", "dst"):
        kept = kept.join(gone.select(F.col("id").alias(end), F.col("removed").alias(f"removed_{end}")), end, "left")
    kept = kept.where("(removed_src is null or removed_src < seq) and (removed_dst is null or removed_dst < seq)")
    return kept.join(closed, "id", "left").select("id", "scope", "ty", "src", "dst", "props", "valid_from", "valid_to")


def vectors(ops: DataFrame) -> DataFrame:
    """The live embedding of each node: the last one since its last removal."""
    last = ops.where("op = 'SetEmbedding'").groupBy("id").agg(F.max_by(F.struct("seq", "model", "vector"), "seq").alias("e"))
    return last.join(_removals(ops), "id", "left").where("removed is null or e.seq > removed").select(
        "id", F.col("e.model").alias("model"), F.col("e.vector").alias("vector"))


def vector_dims(ops: DataFrame) -> DataFrame:
    """The dimension of each model, pinned for good by its first vector."""
    return ops.where("op = 'SetEmbedding'").groupBy("model").agg(F.min_by(F.size("vector"), "seq").alias("dim"))


def resolved(ops: DataFrame, now_ms: int) -> DataFrame:
    """Times that were left open are filled in with the commit's."""
    return ops.withColumns({
        "valid_from": F.when(F.col("op") == "CreateEdge", F.coalesce("valid_from", F.lit(now_ms))).otherwise(F.col("valid_from")),
        "valid_to": F.when(F.col("op") == "CloseEdge", F.coalesce("valid_to", F.lit(now_ms))).otherwise(F.col("valid_to"))})


def ops_since(ops: DataFrame, since: int, floor: int = 1) -> DataFrame:
    """Operations from `since` on, in order; 0 means from the start."""
    from strataloom.model import Compacted

    since = max(since, 1)
    if since < floor:
        raise Compacted(floor)
    return ops.where(F.col("seq") >= since).orderBy("seq")


def current_seq(ops: DataFrame, floor: int = 1) -> DataFrame:
    """The last sequence number; of an emptied log, the one before its floor."""
    return ops.agg(F.coalesce(F.max("seq"), F.lit(floor - 1)).cast("long").alias("current_seq"))


def compacted(ops: DataFrame, keep_from: int) -> DataFrame:
    return ops.where(F.col("seq") >= keep_from)


def counters(bumps: DataFrame) -> DataFrame:
    """Access counts and last access of each node."""
    return bumps.groupBy("id").agg(F.sum("n").cast("long").alias("access_count"), F.max("at").alias("last_accessed_at"))


def superseded(steps: DataFrame) -> DataFrame:
    """Bulk supersession of (scope, src, ty, dst, valid_from, seq): a repeat of the current target changes
    nothing, any other target closes the open edge and opens its own."""
    from pyspark.sql import Window

    w = Window.partitionBy("scope", "src", "ty").orderBy("valid_from", "seq")
    fresh = steps.withColumn("last", F.lag("dst").over(w)).where("last is null or last <> dst").drop("last")
    return fresh.withColumn("valid_to", F.lead("valid_from").over(w))


def unembedded(ops: DataFrame, model: str, label_props: list[tuple[str, str]]) -> DataFrame:
    """Ids of created text nodes that have no vector of the model and were not removed."""
    has_text = F.lit(False)
    for label, prop in label_props:
        has_text = has_text | ((F.col("label") == label) & F.col("props")[prop]["s"].isNotNull())
    made = ops.where((F.col("op") == "CreateNode") & has_text).select("id").distinct()
    done = ops.where((F.col("op") == "SetEmbedding") & (F.col("model") == model)).select("id")
    gone = ops.where("op = 'RemoveNode'").select("id")
    return made.join(done, "id", "left_anti").join(gone, "id", "left_anti")


def rejected_edges(new_edges: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges that a live submit refuses, with the reason: an endpoint is missing, the endpoints are in two
    different scopes, or the edge's scope is neither shared nor its endpoints'."""
    ends = nodes_.select("id", "scope")
    j = new_edges.join(ends.select(F.col("id").alias("src"), F.col("scope").alias("a")), "src", "left").join(
        ends.select(F.col("id").alias("dst"), F.col("scope").alias("b")), "dst", "left")
    own = F.when(F.col("a") != "shared", F.col("a")).when(F.col("b") != "shared", F.col("b"))
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing endpoint").when(
        (F.col("a") != F.col("b")) & (F.col("a") != "shared") & (F.col("b") != "shared"), "cross scope").when(
        own.isNotNull() & (F.col("scope") != own) & (F.col("scope") != "shared"), "edge scope")
    return j.withColumn("reason", reason).where("reason is not null").select(*new_edges.columns, "reason")
