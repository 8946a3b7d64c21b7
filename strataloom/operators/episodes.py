"""Episode and policy analytics: what was retrieved, what of it was used, under which policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.model import ScopeSet, is_open
from strataloom.operators import lookup

INLINE_BYTES = 64 * 1024


def returned(events: DataFrame, *keys: str) -> DataFrame:
    """Hits of retrieval events (array column `hits`), one row each with their rank from 1."""
    return events.select(*keys, F.posexplode("hits").alias("at", "hit")).select(*keys, (F.col("at") + 1).alias("rank"), "hit")


def used_pairs(memories: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id): memories of whose tokens at least half occur in a text.

    A memory of n tokens that is used shares one of its n - ceil(n/2) + 1 rarest tokens with the text; these
    are joined with the texts' tokens, and the pairs found are verified on the sets."""
    m = memories.select("item_id", X.recorder_tokens(F.col("memory")).alias("w")).where(F.size("w") > 0)
    t = texts.select("doc_id", X.recorder_tokens(F.col("text")).alias("v"))
    tokens = t.select("doc_id", F.explode("v").alias("t"))
    own = m.select("item_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    wanted = own.select("t").distinct()
    freq = tokens.join(wanted, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rare = own.join(freq, "t", "left").groupBy("item_id", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("s")).select(
        "item_id", F.explode(F.expr("slice(s, 1, cast(n - ceil(n / 2) + 1 as int)).t")).alias("t"))
    near = rare.join(tokens, "t").select("item_id", "doc_id").distinct()
    both = near.join(m, "item_id").join(t, "doc_id")
    return both.where(F.size(F.array_intersect("w", "v")) >= 0.5 * F.size("w")).select("item_id", "doc_id")


def episode_ops(episodes: DataFrame) -> DataFrame:
    """Edges of finished episodes (episode, event, hits array<struct<id,score>>, channel, used array<string>):
    (src, ty, dst, rank, score, channel)."""
    issued = episodes.select(F.col("episode").alias("src"), F.lit("ISSUED").alias("ty"), F.col("event").alias("dst"),
                             F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"), "channel")
    hits = episodes.select("event", "channel", F.posexplode("hits").alias("at", "hit")).select(
        F.col("event").alias("src"), F.lit("RETURNED").alias("ty"), F.col("hit.id").alias("dst"), (F.col("at") + 1).alias("rank"),
        F.col("hit.score").cast("double").alias("score"), "channel")
    used = episodes.select("event", F.explode("used").alias("dst")).select(
        F.col("event").alias("src"), F.lit("USED").alias("ty"), "dst", F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("channel"))
    return issued.unionByName(hits).unionByName(used)


def artifacts(files: DataFrame) -> DataFrame:
    """Policy artifacts (path, content and further columns): sha, kind, and the content itself up to
    64 KiB; by path."""
    size = F.octet_length("content")
    return files.withColumns({
        "sha": F.sha2("content", 256), "kind": F.when(F.col("path").endswith(".md"), "prompt").otherwise("config"),
        "inline": F.when(size <= INLINE_BYTES, F.col("content"))}).drop("content").orderBy("path")


def matching_versions(includes: DataFrame, wanted: list[str]) -> DataFrame:
    """Versions whose set of included hashes is exactly `wanted`: as many distinct ones, and all of them."""
    want = sorted(set(wanted))
    inside = F.col("sha").isin(want) if want else F.lit(False)
    return includes.distinct().groupBy("version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("found")).where(
        (F.col("n") == len(want)) & (F.col("found") == len(want))).select("version")


def session_digest(nodes: DataFrame, edges: DataFrame, counters: DataFrame, scopes: ScopeSet, newest: int = 10, keep: int = 8,
                   links: int = 3) -> DataFrame:
    """The newest memories with their access counts and the names of their first open links' targets, most
    read first: (id, content, access_count, targets)."""
    top = lookup.nodes_by_label_newest(nodes, scopes, "Memory", newest).select("id", F.col("props")["content"]["s"].alias("content"))
    out = edges.where(scopes.admits(F.col("scope")) & is_open()).join(F.broadcast(top.select(F.col("id").alias("src"))), "src", "left_semi")
    w = Window.partitionBy("src").orderBy("id")
    first = out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= links)
    names = nodes.select(F.col("id").alias("dst"), F.coalesce(F.col("props")["name"]["s"], F.substring(F.col("props")["content"]["s"], 1, 80)).alias("name"))
    aimed = first.join(names, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("t")).select(
        F.col("src").alias("id"), F.col("t.name").alias("targets"))
    return top.join(counters, "id", "left").join(aimed, "id", "left").select(
        "id", "content", F.coalesce("access_count", F.lit(0)).alias("access_count"),
        F.coalesce("targets", F.array().cast("array<string>")).alias("targets")).orderBy(F.desc("access_count"), F.desc("id")).limit(keep)


def render_digest(rows: list, most: int = 6000) -> str:
    """The digest as lines of text, cut at `most` characters."""
    lines = [f"- {r['content']}" + (f" ({', '.join(r['targets'])})" if r["targets"] else "") for r in rows]
    return "\n".join(lines)[:most]
