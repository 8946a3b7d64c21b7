"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the
token windows of whole documents; every hit is verified word by word.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z is lower-cased. A window is `n`
consecutive item words, or all of an item that has fewer. A document word that lies in any
occurrence of a window is hit.

Defined results: a null or empty text has no words and is clean; a null `item_id` contaminates but
is not named; repeated items count once by id, repeated document rows are judged each for itself;
an empty benchmark leaves every document clean; other columns are carried by `decontaminated` and
ignored by `contamination`.

The broadcast set holds the benchmark, never the corpus. Its size is checked: beyond
`max_broadcast_bytes` the items are dealt into blocks of at most that size; documents are scanned
against each block and the hits of a document are merged by its row.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Hidden, stored, steps, text_bytes
from strataloom.llm.words import LOWER, WORDY, window_hashes, word_bounds, word_hashes

WINDOW = 13
MAX_BROADCAST_BYTES = 16 << 20
_FILTER_BITS = 20


class NgramSet:
    """The windows of the benchmark by length: sorted hashes, a bit filter before them, and the
    words themselves for verification."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.windows: dict[tuple[int, int], list[tuple[bytes, set]]] = defaultdict(list)
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low = LOWER[raw]
            starts, ends, _ = word_bounds(low, np.array([0, len(low)]), WORDY)
            if not len(starts):
                continue
            length = min(n, len(starts))
            hashes = window_hashes(word_hashes(low, starts, ends), length)
            for i, h in enumerate(hashes.tolist()):
                words = _joined(low, starts[i : i + length], ends[i : i + length])
                found = self.windows[length, h]
                for known, owners in found:
                    if known == words:
                        owners.add(item)
                        break
                else:
                    found.append((words, {item}))
        self.by_length = {}
        for length in sorted({k for k, _ in self.windows}):
            hashes = np.sort(np.array([h for k, h in self.windows if k == length], np.uint64))
            passing = np.zeros(1 << _FILTER_BITS, bool)
            passing[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[length] = (hashes, passing)

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """For each row: number of words, mask of hit words, items that occur."""
        low = LOWER[data]
        starts, ends, before = word_bounds(low, offsets, WORDY)
        rows = len(offsets) - 1
        hit_from: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        hashes = word_hashes(low, starts, ends) if self.by_length else None
        for length, (known, passing) in self.by_length.items():
            found = window_hashes(hashes, length)
            maybe = np.flatnonzero(passing[found >> np.uint64(64 - _FILTER_BITS)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
            maybe = maybe[known[at] == found[maybe]]
            row = np.searchsorted(before, maybe, side="right") - 1
            within = maybe + length <= before[row + 1]
            for i, r in zip(maybe[within].tolist(), row[within].tolist()):
                words = _joined(low, starts[i : i + length], ends[i : i + length])
                for same, owners in self.windows[length, int(found[i])]:
                    if same == words:
                        hit_from[r].append((i - int(before[r]), length))
                        items[r] |= owners
        return starts, ends, before, rows, hit_from, items


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist()))


def _runs(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows (first word, length) as disjoint word runs [a, b)."""
    out: list[list[int]] = []
    for a, length in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + length)
        else:
            out.append([a, a + length])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, max_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    held = items.agg(F.sum(F.octet_length("words")), F.count(F.lit(1))).first()
    # The set takes about n times the text: each word begins a window.
    parts = max(1, -(-int((held[0] or 0) * WINDOW + 64 * held[1]) // max_bytes))
    if parts == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k) for k in range(parts)]


def hits(documents: DataFrame, benchmark: DataFrame, keep: list[str], n: int = WINDOW,
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES, text: str = "text") -> DataFrame:
    """Every document row with n_words, `runs` (array of struct<a,b>: hit words [a, b)) with their
    byte places `spans`, and `items` (sorted ids that occur). `keep` names the columns to carry, which must
    differ from these four; `decontaminated` hides the caller's."""
    blocks = _blocks(benchmark, max_broadcast_bytes)
    schema = "n_words long, runs array<struct<a:long,b:long>>, spans array<struct<a:long,b:long>>, items array<string>"
    if len(blocks) > 1:
        rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                                F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
        base = stored(rows, "decontaminate")
        found = [_scan(base, ["rid"], b, n, schema, "text") for b in blocks]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        merged = every.groupBy("rid").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = base.select("rid", *[f"k{i}" for i in range(len(keep))]).join(merged, "rid")
        out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words",
                         _merged("runs").alias("runs"), _merged("spans").alias("spans"), "items")
        return out
    return _scan(documents, keep, blocks[0], n, schema, text)


def _merged(column: str):
    """Disjoint runs of an array of [a, b), as a column expression."""
    return F.expr(f"""
        aggregate(array_sort({column}), cast(array() as array<struct<a:long,b:long>>), (out, x) ->
          if(size(out) > 0 and x.a <= element_at(out, -1).b,
             concat(slice(out, 1, size(out) - 1),
                    array(named_struct('a', element_at(out, -1).a, 'b', greatest(element_at(out, -1).b, x.b)))),
             concat(out, array(x))))""")


def _scan(documents: DataFrame, keep: list[str], items: DataFrame, n: int, schema: str, text: str) -> DataFrame:
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
    # The text goes to the workers once, whether or not it is kept.
    sent = documents.select(*keep, *([] if text in keep else [text]))
    at = sent.columns.index(text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[: len(keep)])

    def run(batches):
        grams = NgramSet(shared.value, n)
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            counts, runs, spans, items_of = [], [], [], []
            for a, b in steps(offsets):
                base = offsets[a]
                starts, ends, before, rows, hit_from, items = grams.scan(
                    data[base : offsets[b]], offsets[a : b + 1] - base)
                counts.append(np.diff(before))
                for r in range(rows):
                    own = _runs(hit_from[r]) if r in hit_from else []
                    runs.append([{"a": x, "b": y} for x, y in own])
                    w, zero = int(before[r]), int(offsets[a + r] - base)
                    spans.append([{"a": int(starts[w + x]) - zero, "b": int(ends[w + y - 1]) - zero} for x, y in own])
                    items_of.append(sorted(i for i in items.get(r, ()) if i is not None))
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
                        pa.array(runs, pair), pa.array(spans, pair), pa.array(items_of, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "runs", "spans", "items"])

    return sent.mapInArrow(run, f"{types}, {schema}" if types else schema)


_N_HIT = "aggregate(runs, 0L, (n, x) -> n + x.b - x.a)"


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = 20, **options) -> DataFrame:
    """The verdict on each document row: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated (hit at all, and at least one word in `share`)."""
    found = hits(documents, benchmark, ["doc_id"], n, **options)
    found = found.withColumn("n_hit", F.expr(_N_HIT))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: int = 20,
                   mode: str = "documents", **options) -> DataFrame:
    """Documents without benchmark passages. mode 'documents' drops each contaminated row; 'spans'
    keeps every row and cuts the hit spans out of its text. All columns are kept."""
    hidden = Hidden(documents)
    text = hidden["text"]
    found = hits(hidden.frame, benchmark, hidden.columns, n, text=text, **options).withColumn("n_hit", F.expr(_N_HIT))
    if mode == "documents":
        bad = (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
        return hidden.restored(found.where(~bad))
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    raw = f"encode({text}, 'UTF-8')"
    rest = F.expr(f"""decode(aggregate(spans, named_struct('at', 1, 'out', cast('' as binary)),
        (s, x) -> named_struct('at', cast(x.b + 1 as int),
                               'out', concat(s.out, substring({raw}, s.at, cast(x.a + 1 - s.at as int)))),
        s -> concat(s.out, substring({raw}, s.at))), 'UTF-8')""")
    return hidden.restored(found, text=F.when(F.size("spans") == 0, F.col(text)).otherwise(rest))


def op10_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Words by RE2; each item gives its windows, each document its runs of the same lengths.
OP10_SQL = r"""
WITH bw AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT DISTINCT item, least(13, len(w)) AS n,
           list_aggregate(w[i : i + least(13, len(w)) - 1], 'string_agg', ' ') AS win
         FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT rid, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS win
         FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, d.n, item FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
