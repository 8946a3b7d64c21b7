"""A synthetic workload of memories, entities, edges and embeddings, distributed and reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented words of two or three syllables.
_SYLLABLES = ("ba", "dor", "lin", "mu", "sev", "tak", "ro", "pen")
WORDS = [x + y + z for x in _SYLLABLES for y in _SYLLABLES for z in ("", "s") if x != y]


def memories(spark: SparkSession, n: int, seed: int = 0xC0FFEE) -> DataFrame:
    """(id, scope, label, content): 50 to 500 words each, drawn by a hash of seed and place."""
    words = F.array(*[F.lit(w) for w in WORDS])
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(451)).cast("int") + 50
    text = F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(
        words, F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(WORDS))).cast("int") + 1))
    return spark.range(n).select("id", F.array_join(text, " ").alias("content")).select(
        F.concat(F.lit("M"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("id"), F.lit("shared").alias("scope"),
        F.lit("Memory").alias("label"), "content")


def edges(spark: SparkSession, n: int, seed: int = 0xC0FFEE) -> DataFrame:
    """(src, ty, dst): each memory is about an entity, half mention another, each follows the one before."""
    e = max(1, n // 5)
    name = lambda p, c: F.concat(F.lit(p), F.lpad(c.cast("string"), 12, "0"))
    m = spark.range(n)
    pick = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(e))
    about = m.select(name("M", F.col("id")).alias("src"), F.lit("ABOUT").alias("ty"), name("E", pick(1)).alias("dst"))
    mentions = m.where(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(2)) == 0).select(
        name("M", F.col("id")).alias("src"), F.lit("MENTIONS").alias("ty"), name("E", pick(3)).alias("dst"))
    follows = m.where("id > 0").select(name("M", F.col("id")).alias("src"), F.lit("FOLLOWS").alias("ty"), name("M", F.col("id") - 1).alias("dst"))
    return about.unionByName(mentions).unionByName(follows)
