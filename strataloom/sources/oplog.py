"""The op log: an append-only Parquet table with a manifest.

A batch is validated as a whole, written as one file set, and becomes visible when the next manifest is
created; manifests are created exclusively, so of two writers one fails with Busy and nothing is half
written. All state is a fold of the log (operators.fold)."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.model import (BUMPS, FORMAT_VERSION, OPS, SHARED, Busy, Closed, IndexSpec, Rejected, UnsupportedFormat, value)
from strataloom.operators import fold

ANALYZER_VERSION = 1


@dataclass
class Manifest:
    format_version: int = FORMAT_VERSION
    analyzer_version: int = ANALYZER_VERSION
    version: int = 0
    floor: int = 1
    next_seq: int = 1
    batches: list[int] = field(default_factory=list)
    base: str | None = None
    compacted: bool = False
    dims: dict[str, int] = field(default_factory=dict)
    equality: list[list[str]] = field(default_factory=list)
    text: list[list[str]] = field(default_factory=list)

    def spec(self) -> IndexSpec:
        return IndexSpec(tuple(map(tuple, self.equality)), tuple(map(tuple, self.text)))


def with_retry(budget_ms: int, attempt: Callable[[], object], sleep: Callable[[float], None] = time.sleep):
    """Run `attempt` until it is not Busy, waiting 25 ms and then twice as long each time, 500 ms at most."""
    wait, left = 25, budget_ms
    while True:
        try:
            return attempt()
        except Busy:
            if left <= 0:
                raise
            pause = min(wait, left)
            sleep(pause / 1000)
            left, wait = left - pause, min(wait * 2, 500)


class OpLog:
    """Reads and appends operations under `path` (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec | None = None, stored: bool = False):
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._latest()
        if found is None:
            if stored:
                raise Rejected(f"no store at {path}")
            spec = (spec or IndexSpec()).canonical()
            self.manifest = Manifest(version=0, equality=[list(p) for p in spec.equality], text=[list(p) for p in spec.text])
            self._commit(self.manifest)
        else:
            self.manifest = found
            if spec is not None and spec.canonical() != found.spec():
                wanted = spec.canonical()
                self._next(equality=[list(p) for p in wanted.equality], text=[list(p) for p in wanted.text])

    # ---- manifests

    def _latest(self) -> Manifest | None:
        folder = self._Path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        versions = sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))
        if not versions:
            return None
        stream = self._fs.open(self._Path(f"{self.path}/manifest/{versions[-1]:012d}.json"))
        raw = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if raw["format_version"] > FORMAT_VERSION:
            raise UnsupportedFormat(f"format {raw['format_version']}")
        return Manifest(**raw)

    def _commit(self, m: Manifest) -> None:
        target = self._Path(f"{self.path}/manifest/{m.version:012d}.json")
        try:
            stream = self._fs.create(target, False)
        except Exception as e:
            raise Busy(f"version {m.version} was written by another writer") from e
        stream.write(bytearray(json.dumps(asdict(m)).encode()))
        stream.close()
        self.manifest = m

    def _next(self, **changes) -> None:
        raw = asdict(self.manifest)
        raw.update(changes, version=self.manifest.version + 1)
        self._commit(Manifest(**raw))

    def refresh(self) -> None:
        self.manifest = self._latest() or self.manifest

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    # ---- reading

    def ops(self) -> DataFrame:
        self._open()
        m = self.manifest
        paths = ([m.base] if m.base else []) + [f"{self.path}/ops/batch={b}" for b in m.batches]
        if not paths:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*paths).where(F.col("seq") >= m.floor)

    def ops_since(self, since: int) -> DataFrame:
        return fold.ops_since(self.ops(), since, self.manifest.floor)

    def current_seq(self) -> int:
        self._open()
        return self.manifest.next_seq - 1

    def state_ops(self) -> DataFrame:
        """What the state is folded from: the log, or the snapshot a compaction left and what came after."""
        m = self.manifest
        if not m.compacted:
            return self.ops()
        return self.spark.read.schema(OPS).parquet(f"{self.path}/snapshot/{m.floor:012d}").unionByName(self.ops())

    # ---- writing

    def submit(self, ops: list[dict], now_ms: int | None = None) -> tuple[int, int]:
        """Append a batch; (first, last) sequence numbers. Any invalid operation rejects all of it."""
        self._open()
        now = int(time.time() * 1000) if now_ms is None else now_ms
        if not ops:
            raise Rejected("an empty batch")
        dims = self._validate(ops)
        m, rows = self.manifest, []
        for i, o in enumerate(ops):
            row = dict(o)
            if row["op"] == "CreateEdge" and row["valid_from"] is None:
                row["valid_from"] = now
            if row["op"] == "CloseEdge" and row["valid_to"] is None:
                row["valid_to"] = now
            row["props"] = None if row["props"] is None else {k: value(v) for k, v in row["props"].items()}
            rows.append({"seq": m.next_seq + i, "batch_id": m.version + 1, "committed_ms": now, **row})
        batch = self.spark.createDataFrame([tuple(r[f.name] for f in OPS.fields) for r in rows], OPS)
        batch.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ops/batch={m.version + 1}")
        self._next(next_seq=m.next_seq + len(rows), batches=[*m.batches, m.version + 1], dims=dims)
        return rows[0]["seq"], rows[-1]["seq"]

    def _validate(self, ops: list[dict]) -> dict[str, int]:
        """Check a batch against the state of the ids it names; the models' dimensions after it."""
        named = {o["id"] for o in ops if o["op"] not in ("CreateEdge", "CloseEdge")} | {
            x for o in ops if o["op"] == "CreateEdge" for x in (o["src"], o["dst"])}
        edge_ids = {o["id"] for o in ops if o["op"] in ("CreateEdge", "CloseEdge")}
        state = self.state_ops()
        mine = state.where(F.col("id").isin(list(named)) & F.col("op").isin("CreateNode", "RemoveNode", "SetNodeProps"))
        scopes = {r.id: r.scope for r in fold.nodes(mine).select("id", "scope").collect()} if named else {}
        edges: dict[str, tuple[str, str, bool]] = {}
        if edge_ids:
            for r in fold.edges(state).where(F.col("id").isin(list(edge_ids))).select("id", "src", "dst", "valid_to").collect():
                edges[r.id] = (r.src, r.dst, r.valid_to is not None)
        dims = dict(self.manifest.dims)
        for o in ops:
            kind, x = o["op"], o["id"]
            if kind == "CreateNode":
                if x in scopes:
                    raise Rejected(f"node {x} exists")
                scopes[x] = o["scope"]
            elif kind in ("SetNodeProps", "RemoveNode", "SetEmbedding"):
                if x not in scopes:
                    raise Rejected(f"no node {x}")
                if kind == "RemoveNode":
                    del scopes[x]
                    edges = {e: v for e, v in edges.items() if x not in v[:2]}
                if kind == "SetEmbedding":
                    v = o["vector"]
                    if not v or not all(math.isfinite(f) for f in v):
                        raise Rejected("a vector must be non-empty and finite")
                    if dims.setdefault(o["model"], len(v)) != len(v):
                        raise Rejected(f"model {o['model']} has dimension {dims[o['model']]}")
            elif kind == "CreateEdge":
                a, b = scopes.get(o["src"]), scopes.get(o["dst"])
                if a is None or b is None:
                    raise Rejected("an endpoint is missing")
                own = {s for s in (a, b) if s != SHARED}
                if len(own) > 1:
                    raise Rejected("the endpoints are in different scopes")
                if own and o["scope"] not in own | {SHARED}:
                    raise Rejected("the edge's scope is not its endpoints'")
                if x in edges:
                    raise Rejected(f"edge {x} exists")
                edges[x] = (o["src"], o["dst"], False)
            elif kind == "CloseEdge":
                if x not in edges or edges[x][2]:
                    raise Rejected(f"no open edge {x}")
                edges[x] = (*edges[x][:2], True)
            else:
                raise Rejected(f"unknown operation {kind}")
            for v in (o["props"] or {}).values():
                value(v)
        return dims

    def append_frame(self, ops: DataFrame) -> int:
        """Bulk append of trusted operations (columns of OPS but seq, batch_id, committed_ms; `at` orders
        them): the distributed way in, without the checks of `submit`. Rows appended."""
        from pyspark.sql import Window

        self._open()
        m, now = self.manifest, int(time.time() * 1000)
        parts = ops.repartitionByRange("at").sortWithinPartitions("at").withColumn("p", F.spark_partition_id())
        path = f"{self.path}/staged/{m.version + 1}"
        parts.write.mode("overwrite").parquet(path)
        staged = self.spark.read.parquet(path)
        sizes = staged.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        shift = sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
        own = F.row_number().over(Window.partitionBy("p").orderBy("at"))
        numbered = staged.withColumn("own", own).join(F.broadcast(shift), "p").select(
            (F.lit(m.next_seq - 1) + F.col("shift") + F.col("own")).alias("seq"), F.lit(m.version + 1).cast("long").alias("batch_id"),
            F.lit(now).alias("committed_ms"), *[c.name for c in OPS.fields[3:]])
        numbered.write.mode("overwrite").parquet(f"{self.path}/ops/batch={m.version + 1}")
        n = self.spark.read.parquet(f"{self.path}/ops/batch={m.version + 1}").count()
        self._next(next_seq=m.next_seq + n, batches=[*m.batches, m.version + 1])
        return n

    def compact(self, keep_from: int) -> None:
        """Drop operations before `keep_from`. The state they made is kept as a snapshot; replay from the
        start is no longer possible."""
        self._open()
        m = self.manifest
        if keep_from <= m.floor:
            return
        if keep_from > m.next_seq:
            raise Rejected("cannot drop what is not written yet")
        state = self.state_ops().where(F.col("seq") < keep_from)
        _snapshot(state).write.mode("overwrite").parquet(f"{self.path}/snapshot/{keep_from:012d}")
        base = f"{self.path}/compacted/{keep_from:012d}"
        fold.compacted(self.ops(), keep_from).write.mode("overwrite").parquet(base)
        self._next(floor=keep_from, batches=[], base=base, compacted=True)

    # ---- access counts, outside the log

    def bump(self, ids: Iterable[str], now_ms: int) -> None:
        rows = [(x, 1, now_ms) for x in ids]
        if rows:
            self.spark.createDataFrame(rows, BUMPS).coalesce(1).write.mode("append").parquet(f"{self.path}/bumps")

    def bumps(self) -> DataFrame:
        if not self._fs.exists(self._Path(f"{self.path}/bumps")):
            return self.spark.createDataFrame([], BUMPS)
        return self.spark.read.schema(BUMPS).parquet(f"{self.path}/bumps")


def _snapshot(state: DataFrame) -> DataFrame:
    """The least operations that fold to the same state: they keep the sequence numbers that decide folds."""
    last = state.where("op = 'RemoveNode'").groupBy("id").agg(F.max("seq").alias("gone"))
    kept = state.where("op <> 'RemoveNode'")
    for column in ("id", "src", "dst"):
        kept = kept.join(last.select(F.col("id").alias("g"), F.col("gone")), F.col(column) == F.col("g"), "left").where(
            "gone is null or gone < seq").drop("g", "gone")
    return kept.select(*[f.name for f in OPS.fields])
