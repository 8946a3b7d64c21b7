"""Helpers shared by the operators: Arrow text buffers, hashing, shared tables, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20

#: Edges whose components one task finds: 16 MB.
ONE_TASK_EDGES = 1 << 20

#: Bytes of the tables that a shared table is made of for each file of it, beside one file a core.
FILE_BYTES = 1 << 21

U64 = np.uint64


# ---------------------------------------------------------------- shared tables


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset and all runs in one process (tests), a temporary folder is chosen once and kept in the
    session's settings. Elsewhere that would be a folder of one machine, which others cannot read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strataloom.workdir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("strataloom.workdir", found)
    return found.rstrip("/")


def _file_count(df: DataFrame) -> int:
    """Files that suffice for `df`, by the size of the tables it is made of: one a core, and more as these grow."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.sparkSession.sparkContext.defaultParallelism + size // FILE_BYTES


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage is cut, and what was
    not deterministic (row numbers) is now fixed for every later reader.

    Small tables in many partitions are written in few files. Without Hadoop's native library each file costs
    the executor two or more forks (chmod of the file and of its checksum)."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.coalesce(min(_file_count(df), (1 << 31) - 1)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """As `stored`, dealt to buckets by `key`: joins by it shuffle the other side alone, so that texts
    travel once however many joins fetch them."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"strataloom_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{work_dir(spark)}/llm/{name}"
    df.repartition(buckets, key).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(
        buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._strataloom_path, out._strataloom_table = path, name
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that `stored` or `stored_by` wrote and that nothing reads any more."""
    path = getattr(df, "_strataloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if hasattr(df, "_strataloom_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._strataloom_table}")


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have ended: it does so when the driver's objects for
    them are collected, which may else be after the last step."""
    gc.collect()
    spark._jvm.System.gc()


class Hidden:
    """The caller's columns under names of their places (k0, k1, ...), so that none clashes with what an
    operator adds, and the way back."""

    def __init__(self, documents: DataFrame):
        self.names = documents.columns
        self.columns = [f"k{i}" for i in range(len(self.names))]
        self.frame = documents.toDF(*self.columns)

    def __getitem__(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def restored(self, frame: DataFrame, **changed: Column) -> DataFrame:
        """The caller's columns of `frame`, by name, but for those `changed`."""
        return frame.select(*[changed.get(n, F.col(k)).alias(n) for n, k in zip(self.names, self.columns)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow text as bytes


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty. No copy is made
    unless the column holds nulls over hidden bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes stay under `limit`, or single rows that exceed it."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                up, down = np.full(size, self.base, U64), np.full(size, self.inverse, U64)
                up[0] = down[0] = 1
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
            if size > 4 * STEP_BYTES:  # not kept: one very long text must not hold memory
                return up[:n], down[:n]
            self.up, self.down, self.n = up, down, size
        return self.up[:n], self.down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value, from a seed."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


# ---------------------------------------------------------------- distributed helpers


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, salt: Column, salts: int = 64) -> DataFrame:
    """Number rows from 0 within `keys` without one task per key: rows are dealt to (keys, salt)
    cells, numbered there, and shifted by the counts of the cells before. `salt` must be a
    deterministic function of the row."""
    from pyspark.sql import Window

    cell = [*keys, "__salt"]
    dealt = df.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    sizes = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__own", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    same = numbered["__salt"] == shift["__salt"]
    for k in keys:
        same = same & numbered[k].eqNullSafe(shift[k])
    joined = numbered.join(shift, same, "left")
    kept = [numbered[c] for c in df.columns]
    return joined.select(*kept, (numbered["__own"] - 1 + shift["__before"]).cast("long").alias(out))


def forest_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges with the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, max_rounds: int = 40, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of undirected `edges` (u long, v long) as (node, root), where root is
    the component's smallest node. Up to `one_task` edges, counted first, are joined in one task. More go
    through alternating large-star and small-star rounds, each written to the shared folder; the number of
    rounds grows with the logarithm of the longest path."""
    if edges.count() <= one_task:

        def join(batches):
            ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for batch in batches:
                for k in (0, 1):
                    ends[k].append(batch.column(k).to_numpy())
            node, root = forest_roots(*map(np.concatenate, ends))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        return stored(edges.where("u <> v").select("u", "v").coalesce(1).mapInArrow(join, "node long, root long"), "cc")
    state = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    nodes = state

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        return tuple(row)

    was = mark(state)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low2, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        after = stored(small.distinct(), "cc")
        now = mark(after)
        if state is not nodes:
            dropped(state)
        state = after
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not converge")
    members = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
