"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes: every byte shifts the hash by one bit and adds a random code
of its own, so the 16-bit hash depends on the last 16 bytes alone. A chunk ends where the hash's upper bits
are zero (after `least` bytes at least, `most` at most). An insertion moves boundaries only until the
next content-defined one; the chunks after it are the same again. Chunks are filed under a 128-bit
BLAKE2b digest. The first occurrence of a digest - least row, then least place - stays. Later
occurrences are repeats; runs of neighbouring repeats of at least `run_bytes` bytes are removed, and a
text all of whose chunks are repeats is removed whole. Shorter runs stay, so a common phrase or line is no
reason to cut a text; a passage's first and last chunk, which it shares in part only, stay too.

Digests are counted by an aggregate with map-side combine, and joined back by digest, so one digest with
a third of all chunks is neither one task's work nor pairs.

Defined results: null and empty texts have no chunk and are kept as they are; of equal rows the first
keeps its text; a very long text is chunked in one pass over its bytes; an empty table gives no row;
other columns are carried by `deduplicated`. Chunk ends fall between UTF-8 characters, so that what is
left is valid text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Hidden, byte_codes, dropped, steps, stored, stored_by, text_bytes

LEAST, BITS, MOST = 16, 5, 160
RUN_BYTES = 80
#: Keys over which rows with repeats of their own are spread.
MARKERS = 64

#: Bytes that the rolling hash remembers: its bits.
MEMORY = 16
_GEAR = (byte_codes(5) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum over the last 16 bytes of code << age. Built by doubling
    the number of bytes it covers."""
    with np.errstate(over="ignore"):
        h = _GEAR[data]
        for age in (1, 2, 4, 8):
            if len(h) > age:
                h[age:] = h[age:] + (h[:-age] << np.uint16(age))
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[np.ndarray]:
    """Ends of the chunks of each row, counted from the row's start."""
    if least < MEMORY:
        raise ValueError("a first chunk as long as the hash's memory keeps it within its row")
    h = gear_hashes(data)
    # The upper bits see all 16 bytes. A cut comes before a byte that begins a character.
    begins = np.ones(len(data) + 1, bool)
    begins[:-1] = (data & 0xC0) != 0x80
    cuts = np.flatnonzero((h >> np.uint16(MEMORY - bits) == 0) & begins[1:]) + 1
    low, out = np.searchsorted(cuts, offsets), []
    for r in range(len(offsets) - 1):
        zero, size = int(offsets[r]), int(offsets[r + 1] - offsets[r])
        ends, last = [], 0
        own = (cuts[low[r] : low[r + 1] + 1] - zero).tolist()
        for cut in own:
            if cut > size:
                break
            while cut - last > most:  # no cut for long: a forced one, at a character
                forced = last + most
                while not begins[zero + forced]:
                    forced -= 1
                ends.append(forced)
                last = forced
            if cut - last >= least:
                ends.append(cut)
                last = cut
        while size - last > most:
            forced = last + most
            while not begins[zero + forced]:
                forced -= 1
            ends.append(forced)
            last = forced
        if size > last:
            ends.append(size)
        out.append(np.array(ends, np.int64))
    return out


def _digests(part: np.ndarray, off: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Digests of each row's chunks as (chunks, 2) longs."""
    view, out = memoryview(part.tobytes()), []
    for zero, own in zip(off[:-1].tolist(), ends):
        stops = (own + zero).tolist()
        joined = b"".join([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip([zero, *stops], stops)])
        out.append(np.frombuffer(joined, np.int64).reshape(-1, 2))
    return out


def _distinct_chunks(base: DataFrame, least: int, bits: int, most: int, markers: bool) -> DataFrame:
    """(rid, d1, d2): the distinct digests of each row. With `markers`, a row that holds a chunk twice
    gives one more, (rid % MARKERS, 0): it has repeats whatever the other rows hold."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, owners = [], []
                for rid, pair in zip(rids[a:b].tolist(), _digests(part, off, chunk_ends(part, off, least, bits, most))):
                    own = {tuple(d) for d in pair.tolist()}
                    if markers and len(own) < len(pair):
                        own.add((rid % MARKERS, 0))
                    found.extend(own)
                    owners.append(np.full(len(own), rid))
                if found:
                    flat = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(owners)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["rid", "d1", "d2"])

    return base.select("rid", "text").mapInArrow(run, "rid long, d1 long, d2 long")


def _runs(ends: np.ndarray, repeated: np.ndarray, run_bytes: int) -> list[tuple[int, int]]:
    """Byte spans of neighbouring repeated chunks that make up at least `run_bytes`, or the whole text."""
    if len(ends) and repeated.all():
        return [(0, int(ends[-1]))]
    begins = np.concatenate([[0], ends[:-1]])
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [(a, b) for a, b in zip(begins[first].tolist(), ends[last].tolist()) if b - a >= run_bytes]


def _cut_documents(base: DataFrame, run_bytes: int, least: int, bits: int, most: int) -> DataFrame:
    """rid with the text that is left and what was removed, for rows that lose something."""
    spark = base.sparkSession
    firsts = _distinct_chunks(base, least, bits, most, False).groupBy("d1", "d2").agg(
        F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    markers = spark.range(MARKERS).select(F.col("id").alias("d1"), F.lit(0).cast("long").alias("d2"),
                                          F.lit(-1).cast("long").alias("first"))
    firsts = stored(firsts.unionByName(markers), "firsts")
    later = _distinct_chunks(base, least, bits, most, True).join(firsts, ["d1", "d2"]).where("rid <> first")
    # Within a row the upper half of a digest is enough to tell which of its own chunks is meant.
    marks = stored(later.groupBy("rid").agg(F.collect_list("d1").alias("marks")), "repeats")
    dropped(firsts)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rids, marked, out = batch.column(0), batch.column(2), []
            for a, b in steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ends = chunk_ends(part, off, least, bits, most)
                for r, (own, pair) in enumerate(zip(ends, _digests(part, off, ends))):
                    raw = part[off[r] : off[r + 1]].tobytes()
                    again = np.ones(len(pair), bool)
                    again[np.unique(pair[:, 0], return_index=True)[1]] = False  # all but a chunk's first place
                    repeated = again | np.isin(pair[:, 0], marked[a + r].values.to_numpy())
                    spans = _runs(own, repeated, run_bytes)
                    edges = [0, *(x for span in spans for x in span), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    out.append((len(raw) - len(kept), len(spans), kept.decode()))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [rids, *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))]],
                ["rid", "removed", "spans", "kept"])

    return base.select("rid", "text").join(marks, "rid").mapInArrow(
        run, "rid long, removed long, spans long, kept string").where("removed > 0")


def chunk_cuts(documents: DataFrame, run_bytes: int = RUN_BYTES, least: int = LEAST, bits: int = BITS,
               most: int = MOST) -> tuple[Hidden, DataFrame]:
    """The caller's columns (hidden, by place) of every row with `text`, what is left of it, and n_bytes, n_removed
    and n_spans."""
    hidden = Hidden(documents)
    own = F.col(hidden["text"])
    base = stored_by(hidden.frame.withColumn("rid", F.monotonically_increasing_id()), "rid", "chunks-base")
    cut = _cut_documents(base.where(own.isNotNull()).select("rid", own.alias("text")), run_bytes, least, bits, most)
    joined = base.join(cut, "rid", "left")
    return hidden, joined.select(
        *hidden.columns, F.when(F.col("removed").isNull(), own).otherwise(F.col("kept")).alias("text"),
        F.coalesce(F.octet_length(own), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"))


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """All rows and columns of `documents`, with repeats cut from `text`."""
    hidden, cut = chunk_cuts(documents, **options)
    return hidden.restored(cut, text=F.col("text"))


def op5_query(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes, kept_sha256 and the text that is left."""
    from strataloom.llm.common import read_table

    hidden, out = chunk_cuts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col(hidden["doc_id"]).alias("doc_id"), "n_bytes", "n_removed", "n_spans", (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce("text", F.lit("")).alias("kept_text"))
