"""The change feed, access counters and retrieval episodes as streams.

The log is the only source; its sequence numbers make replays idempotent. The feed has no event time and no
watermark; only episodes close after a gap, and say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.model import BUMPS, OPS


def changes(spark: SparkSession, path: str, since: int = 1) -> DataFrame:
    """Operations as they are appended, from `since` on. A reader that finds a gap in the numbers reads the
    rest with ops_since."""
    return spark.readStream.schema(OPS).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/ops").where(
        F.col("seq") >= since)


def live_counters(bumps: DataFrame) -> DataFrame:
    """Running access counts (complete output): counts add up, the last access wins."""
    return bumps.groupBy("id").agg(F.sum("n").alias("access_count"), F.max("at").alias("last_accessed_at"))


def bump_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BUMPS).parquet(f"{path.rstrip('/')}/bumps")


def coalesced(bumps: DataFrame, window_ms: int = 100) -> DataFrame:
    """Bumps of an id that fall into one short window as one."""
    slot = F.floor(F.col("at") / window_ms)
    return bumps.groupBy("id", slot.alias("slot")).agg(F.sum("n").alias("n"), F.max("at").alias("at")).drop("slot")


def episodes(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of retrievals (session, ts, query, hits): an episode ends after `gap` without one; events
    later than `late` are dropped, the only watermark there is."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("session", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("retrievals"), F.sum(F.size("hits")).alias("returned")).select(
        "session", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "retrievals", "returned")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the result as a table. For tests and catch-up runs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
