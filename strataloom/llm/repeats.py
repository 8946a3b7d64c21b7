"""Suffix-array deduplication of long repeats through a run-length index.

Every byte that is covered by a `length`-byte string which also starts anywhere else in the corpus -
another document or the same one, overlaps included - is removed. Strings are judged on the input.

1. Anchors. A `gram`-byte gram is an anchor if its hash is the least of some window of
   length - gram + 1 neighbouring grams. Any string of `length` bytes holds an anchor, chosen by its
   own content alone; so two equal strings hold equal anchors at equal places. The bytes that such
   strings can reach from an anchor are its context (up to 2 * length - gram bytes).
2. Anchors that occur once are dropped by an aggregate over their hashes. Contexts that occur more than
   once as a whole are repeats from end to end: copies are resolved here, by a count, and go on as one
   text.
3. Anchors with different contexts go to buckets by anchor, bounded in bytes. Each bucket builds the
   Burrows-Wheeler transform of its contexts (overlapping ones of one document merged, so no two
   suffixes are the same place), compresses it to runs and samples the suffixes at run ends. Only there
   are longest common prefixes compared byte by byte; all others follow by streaming along the text,
   because within a run the prefix shrinks by one per step. The larger of the two neighbours' prefixes
   is the matching statistic of a position; positions of at least `length` mark their match.
4. An anchor with more than `max_variants` different contexts would overfill a bucket. A string of
   `length` bytes about an anchor holds one of `FINER` longer grams about it, so its contexts are told
   apart by those; contexts that share none with another are done, the others go to buckets by them. Where
   even a longer gram is that common, ranges of starts are narrowed by digests in distributed aggregates,
   down to single strings at the edges of what is shared; that is exact and holds no group in one task.

Defined results: a null text is empty; texts shorter than `length` bytes lose nothing; equal rows are
documents of their own and repeat each other; an empty table gives no row; other columns are ignored.
Removed bytes may cut a UTF-8 character; results are bytes, and `kept_text` decodes with replacement.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import U64, Powers, byte_codes, dropped, mix64, steps, stored, text_bytes

LENGTH = 400
GRAM = 128
MAX_VARIANTS = 512
#: Longer grams about a crowded anchor.
FINER = 4
#: Bytes scanned for anchors at once: their hashes fit a processor's cache.
ANCHOR_STEP = 1 << 18
#: Context bytes of a bucket, on average.
BUCKET_BYTES = 1 << 20

_CODES = byte_codes(29)
_POWERS = Powers(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- anchors


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        up, down = _POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
        return mix64((sums[gram:] - sums[:n]) * down[:n])


def _sliding(x: np.ndarray, w: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over [i, i + w) for each i; the array counts as continued with `fill`."""
    n = len(x)
    padded = np.full(-(-(n + w) // w) * w, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    before = ufunc.accumulate(blocks, axis=1).ravel()
    after = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(after[:n], before[w - 1 : w - 1 + n])


def anchor_places(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of each row that is long enough."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = _gram_hashes(data, gram)
    size = np.diff(offsets)
    top = U64(0xFFFFFFFFFFFFFFFF)
    # Grams that cross into the next row, and rows that are too short, take no part.
    row = np.repeat(np.arange(len(size)), size)[: len(h)]
    valid = (np.arange(len(h)) + gram <= offsets[row + 1]) & (size[row] >= length)
    h = np.where(valid, np.minimum(h, top - U64(1)), top)
    w = length - gram + 1
    least = _sliding(h, w, np.minimum, int(top))
    least[len(h) - w + 1 :] = 0  # windows past the end don't count
    # The largest of the window minima over the windows [p - w + 1, p].
    best = _sliding(least[::-1].copy(), w, np.maximum, 0)[::-1]
    at = np.flatnonzero((h == best) & valid)
    return at, h[at]


def _anchors(base: DataFrame, length: int, gram: int) -> DataFrame:
    """rid, pos, fp and the 128-bit digest (c1, c2) of the context of every anchor."""
    left = length - gram

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in steps(offsets, ANCHOR_STEP):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                at, fp = anchor_places(part, off, length, gram)
                row = np.searchsorted(off, at, side="right") - 1
                view = memoryview(part.tobytes())
                begin = np.maximum(at - left, off[row])
                end = np.minimum(at + length, off[row + 1])
                digests = b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(begin.tolist(), end.tolist())])
                pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[a + row]), pa.array((at - off[row]).astype(np.int32)), pa.array(fp.view(np.int64)),
                     pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["rid", "pos", "fp", "c1", "c2"])

    return base.select("rid", "text").mapInArrow(run, "rid long, pos int, fp long, c1 long, c2 long")


# ---------------------------------------------------------------- run-length index


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several texts with sampled run ends."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        n = int((sizes + 1).sum())
        symbols = np.zeros(n + 8, np.int16)  # 0 ends a text, bytes are 1 to 256
        for at, t in zip(self.starts.tolist(), texts):
            symbols[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        self.symbols, self.n = symbols, n
        self.text_of = np.repeat(np.arange(len(texts)), sizes + 1)
        self.rest = self.starts[self.text_of] + sizes[self.text_of] - np.arange(n)  # symbols before the end
        order = self._suffixes()
        before = np.where(order > 0, symbols[order - 1], 0)
        # An end symbol differs from every other one, so a text's first suffix is a run of its own.
        edge = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(np.concatenate([[True], edge]))
        tails = np.flatnonzero(np.concatenate([edge, [True]]))
        self.runs = list(zip(before[heads].tolist(), np.diff(np.append(heads, n)).tolist()))
        # Samples: the suffix at each run's head with the one before, at each tail with the one after.
        self.head_samples = order[heads], np.where(heads > 0, order[heads - 1], -1)
        self.tail_samples = order[tails], np.where(tails < n - 1, order[np.minimum(tails + 1, n - 1)], -1)

    def _suffixes(self) -> np.ndarray:
        """Suffix array by prefix doubling; only suffixes that still tie are sorted again. Those that end within
        the first symbols are told apart by text at once, so that a tie of h symbols never reaches past an end."""
        n, h = self.n, 7
        key = np.zeros(n, np.int64)
        for j in range(h):
            key = key << 9 | np.where(self.rest >= j, self.symbols[j : n + j], 0)
        order = np.argsort(key).astype(np.int32)
        ended = self.rest[order] < h
        short = order[ended]
        order[ended] = short[np.lexsort((short, key[short]))]
        ordered = key[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) | ended
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = group
        slots = np.flatnonzero(~first | ~np.append(first[1:], True))
        who, group = order[slots], group[slots]
        while len(slots):
            pair = group * n + rank[who + h]
            sub = np.argsort(pair)
            who, pair = who[sub], pair[sub]
            order[slots] = who
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            group = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            rank[who] = group
            tied = ~new | ~np.append(new[1:], True)
            slots, who, group = slots[tied], who[tied], group[tied]
            h *= 2
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at a and b, within their texts."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        most = np.minimum(self.rest[a], np.where(b >= 0, self.rest[b], 0))
        step = 16
        while len(live):
            at = out[live][:, None] + np.arange(step)
            limit = most[live]
            x = self.symbols[np.minimum(a[live][:, None] + at, self.n)]
            y = self.symbols[np.minimum(b[live][:, None] + at, self.n)]
            same = (x == y) & (at < limit[:, None])
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            out[live] += run
            live = live[(run == step) & (out[live] < limit)]
            step = min(2 * step, 128)
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place, the length of the longest string that starts there and also elsewhere."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for at, other in (self.head_samples, self.tail_samples):
            known = np.full(self.n, -1, np.int64)
            known[at] = self._common(at, other)
            source = np.maximum.accumulate(np.where(known >= 0, place, 0))
            best = np.maximum(best, known[source] - (place - source))
        return best


def repeated_spans(texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of the merged parts of the texts that are covered by repeats."""
    index = RunLengthIndex(texts)
    at = np.flatnonzero(index.matching_statistics() >= length)
    if not len(at):
        return []
    text, local = index.text_of[at], at - index.starts[index.text_of[at]]
    fresh = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(local) > length)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(text[first].tolist(), local[first].tolist(), (local[last] + length).tolist()))


def _bucket_spans(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of one bucket's contexts (rid, start, ctx)."""
    frame = frame.sort_values(["rid", "start"])
    owners, texts = [], []
    for rid, start, ctx in zip(frame["rid"].tolist(), frame["start"].tolist(), frame["ctx"]):
        if owners and owners[-1][0] == rid and start < owners[-1][1] + len(texts[-1]):
            known = owners[-1][1] + len(texts[-1])
            texts[-1] += bytes(ctx)[max(0, known - start) :]
        else:
            owners.append((rid, start))
            texts.append(bytes(ctx))
    spans = [(owners[t][0], owners[t][1] + a, owners[t][1] + b) for t, a, b in repeated_spans(texts, length)]
    return pd.DataFrame(spans, columns=["rid", "a", "b"]).astype("int64")


# ---------------------------------------------------------------- distributed


def _built(side: DataFrame) -> DataFrame:
    """The side of a join that is hashed: it has numbers only, a row or few for each key, so that the other
    side's anchors, contexts or texts need not be sorted."""
    return side.hint("shuffle_hash")


def _parts(lo: int, hi: int) -> list[tuple[int, int]]:
    """The range [lo, hi] cut into at most FINER ranges that depend on lo and hi alone."""
    edges = sorted({lo + (hi + 1 - lo) * k // FINER for k in range(FINER + 1)})
    return [(x, y - 1) for x, y in zip(edges, edges[1:])]


def _range_digests(ranges: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """Digests that settle or split ranges of starts. A start is counted in bytes left of the anchor. For
    each range: the string that all its starts together cover (`whole`), and for each of its parts the
    string that every start of the part covers; a part of one start is `whole` itself."""
    lists = ranges.groupBy("cid").agg(F.collect_list(F.struct("lo", "hi", "open")).alias("ranges"))

    def run(batches):
        for batch in batches:
            out, digests = [], []
            for cid, at, fp, ctx, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for r in own:
                    lo, hi = r["lo"], r["hi"]
                    strings = [(lo, hi, at - hi, at + length - lo, True)]
                    if lo < hi:
                        strings += [(x, y, at - x, at + length - y, x == y) for x, y in _parts(lo, hi)]
                    for x, y, a, b, whole in strings:
                        if a >= 0 and b <= len(ctx):
                            out.append((cid, lo, hi, x, y, whole, r["open"]))
                            digests.append(hashlib.blake2b(ctx[a:b], digest_size=16, salt=struct.pack("<II?", x, y, whole),
                                                           key=fp.to_bytes(8, "little", signed=True)).digest())
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(cols, kinds)], pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["cid", "from_lo", "from_hi", "lo", "hi", "whole", "open", "d1", "d2"])

    return contexts.join(_built(lists), "cid").select("cid", "at", "fp", "ctx", "ranges").mapInArrow(
        run, "cid long, from_lo int, from_hi int, lo int, hi int, whole boolean, open boolean, d1 long, d2 long")


def _settled(ranges: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """(cid, lo, hi): ranges of starts all of whose strings are repeated, found by narrowing `ranges`.
    Strings of one anchor and one start are compared by digest, in distributed aggregates; a range is
    settled when its whole string is common, given up when its shared one is not, else cut into parts. The
    rounds end with single starts: their number grows with the logarithm of a range's length.

    A settled range may hold a string that an open one shares with no other. It goes on as a witness, one
    for each whole string, wherever an open range shares a part with it."""
    settled, ranges = None, stored(ranges.withColumn("open", F.lit(True)), "ranges")
    while settled is None or not ranges.isEmpty():
        digests = stored(_range_digests(ranges, contexts, length), "range-digests")
        dropped(ranges)
        common = digests.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("first")).where("c > 1")
        hits = stored(digests.join(_built(common.drop("c")), ["d1", "d2"]), "range-hits")
        dropped(digests)
        done = hits.where("whole").select("cid", "lo", "hi", "first", "open")
        found = done.where("open").select("cid", "lo", "hi")
        settled = found if settled is None else settled.unionByName(found)
        closed = done.select("cid", F.col("lo").alias("from_lo"), F.col("hi").alias("from_hi"), F.col("first").alias("witness"))
        parts = hits.where("not whole").join(_built(closed), ["cid", "from_lo", "from_hi"], "left").where(
            "witness is null or witness = cid").select("cid", "lo", "hi", "d1", "d2", (F.col("open") & F.col("witness").isNull()).alias("open"))
        wanted = parts.groupBy("d1", "d2").agg(F.max("open").alias("wanted")).where("wanted").select("d1", "d2")
        ranges = stored(parts.join(_built(wanted), ["d1", "d2"], "left_semi").select("cid", "lo", "hi", "open"), "ranges")
    return settled


def _longer_grams(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(cid, lo, hi, d1, d2): digests of the FINER grams about each context's anchor. The j-th reaches from
    j / FINER of the way left to the rest of the way right, less one part; a string of `length` bytes that
    starts in the j-th part holds it whole."""
    spare = length - gram
    cuts = [spare * j // FINER for j in range(FINER + 1)]

    def run(batches):
        for batch in batches:
            cids, parts, out = [], [], []
            for cid, at, fp, ctx in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for j in range(FINER):
                    a, b = at - cuts[j], at + gram + spare - cuts[j + 1]
                    if a >= 0 and b <= len(ctx):
                        cids.append(cid)
                        parts.append((cuts[j], cuts[j + 1]))
                        out.append(hashlib.blake2b(ctx[a:b], digest_size=16, salt=b"%d" % j, key=fp.to_bytes(8, "little", signed=True)).digest())
            pair = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array([x for x, _ in parts], pa.int32()),
                 pa.array([y for _, y in parts], pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["cid", "lo", "hi", "d1", "d2"])

    return contexts.select("cid", "at", "fp", "ctx").mapInArrow(
        run, "cid long, lo int, hi int, d1 long, d2 long")


def repeat_spans(base: DataFrame, length: int = LENGTH, gram: int = GRAM, max_variants: int = MAX_VARIANTS,
                 bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rid, text) of the documents that hold a repeated anchor, and marks (rid, a, b) whose union is
    what is covered by repeats. `base` has a unique `rid`."""
    left = length - gram
    anchors = stored(_anchors(base, length, gram), "anchors")
    # Written before the join, so that both of its sides are plain exchanges and a hot anchor can be split.
    often = stored(anchors.groupBy("fp").agg(
        F.count(F.lit(1)).alias("total"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
    ).where("total > 1").select("fp", F.expr("min_c1 <> max_c1 or min_c2 <> max_c2").alias("mixed")), "repeated-fps")
    again = stored(anchors.join(_built(often), "fp"), "repeated-anchors")
    dropped(anchors)
    dropped(often)
    # A context that both ends of its text clip is one place, however many anchors have it: it is no copy of
    # itself, but may hold a repeat.
    start = F.greatest(F.col("pos") - left, F.lit(0))
    kinds = stored(again.groupBy("fp", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"), F.max("rid").alias("last"), F.min(start).alias("one"), F.max(start).alias("other"),
        F.min_by("pos", "rid").alias("pos"), F.max("mixed").alias("mixed")).select(
        "fp", "c1", "c2", F.struct("rid", "pos").alias("rep"), "mixed", F.expr("rid <> last or one <> other").alias("copied"),
        F.expr("n > 1 and rid = last and one = other").alias("within")), "kinds")
    copies = again.join(_built(kinds.where("copied").select("fp", "c1", "c2")), ["fp", "c1", "c2"]).select("rid", "pos")
    crowded = kinds.where("mixed").groupBy("fp").agg(F.count(F.lit(1)).alias("v")).where(F.col("v") > max_variants)
    crowd = crowded.select("fp", F.lit(True).alias("crowded"))
    lends = kinds.where("mixed or within").join(crowd, "fp", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    # A crowded anchor's digests compare contexts; repeats within one are found by its index.
    ways = F.when(F.col("crowded") & F.col("within"), F.array(F.lit(True), F.lit(False))).otherwise(F.array("crowded"))
    reps = lends.select("rep", "fp", F.explode(ways).alias("crowded")).select(
        F.col("rep.rid").alias("rid"), F.struct(F.col("rep.pos").alias("pos"), "fp", "crowded").alias("r"))
    wanted = again.select("rid").distinct()
    # One pass over the texts: the documents concerned, each with the anchors whose contexts it lends.
    lent = reps.groupBy("rid").agg(F.collect_list("r").alias("reps"))
    touched = stored(base.join(_built(wanted), "rid").join(_built(lent), "rid", "left").select("rid", "text", "reps"), "touched")

    each = touched.where("reps is not null").select("rid", F.encode("text", "UTF-8").alias("raw"), F.explode("reps").alias("r"))
    begin = F.greatest(F.col("r.pos") - left, F.lit(0))
    contexts = stored(each.select(
        "rid", begin.cast("long").alias("start"), (F.col("r.pos") - begin).cast("int").alias("at"), F.col("r.fp").alias("fp"),
        F.col("r.crowded").alias("crowded"), F.monotonically_increasing_id().alias("cid"),
        F.expr(f"substring(raw, greatest(r.pos - {left}, 0) + 1, r.pos + {length} - greatest(r.pos - {left}, 0))").alias("ctx")
    ).where(F.octet_length("ctx") >= length), "contexts")
    finer = stored(_longer_grams(contexts.where("crowded"), length, gram), "longer-grams")
    common = finer.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    alive = stored(finer.join(_built(common), ["d1", "d2"]), "common-grams")
    texts = contexts.where("crowded").select("cid", "rid", "start", "ctx")
    regrouped = texts.join(_built(alive.where(F.col("c") <= max_variants).select("cid", F.xxhash64("d1", "d2").alias("key"))), "cid").select(
        "cid", "key", "rid", "start", "ctx")
    plain = contexts.where("not crowded").select("cid", F.xxhash64("fp").alias("key"), "rid", "start", "ctx")
    indexed = plain.unionByName(regrouped)
    size = indexed.agg(F.sum(F.octet_length("ctx"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    found = indexed.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "rid", "start", "ctx").groupBy(
        "bucket").applyInPandas(_bucket_task(length), "rid long, a long, b long")

    settled = _settled(alive.where(F.col("c") > max_variants).select("cid", "lo", "hi"),
                       contexts.where("crowded").select("cid", "at", "fp", "ctx"), length)
    strings = settled.join(_built(contexts.where("crowded").select("cid", "rid", "start", "at")), "cid").select(
        "rid", (F.col("start") + F.col("at") - F.col("hi")).alias("a"), (F.col("start") + F.col("at") - F.col("lo") + length).alias("b"))

    whole = copies.join(_built(touched.select("rid", F.octet_length("text").alias("n"))), "rid").select(
        "rid", F.greatest(F.col("pos") - left, F.lit(0)).cast("long").alias("a"),
        F.least(F.col("pos") + length, F.col("n")).cast("long").alias("b")).where(F.col("b") - F.col("a") >= length)
    return touched.select("rid", "text"), whole.unionByName(found).unionByName(strings)


def _bucket_task(length: int):
    def run(frame):
        return _bucket_spans(frame, length)

    return run


def _cut(pairs, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def removed_repeats(documents: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row (kept_text is null
    where nothing was removed)."""
    base = stored(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                   F.monotonically_increasing_id().alias("rid")), "repeats-base")
    touched, marks = repeat_spans(base.select("rid", "text"), length, **options)
    by_row = marks.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("marks"))

    def run(batches):
        for batch in batches:
            out = []
            for text, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                spans = _cut([(m["a"], m["b"]) for m in marked], len(raw))
                edges = [0, *(x for span in spans for x in span), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "replace")))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]],
                ["rid", "r", "s", "sha", "kept_text"])

    cut = touched.join(by_row.hint("shuffle_hash"), "rid").mapInArrow(run, "rid long, r long, s long, sha string, kept_text string")
    plain = base.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    return plain.join(cut, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("r", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("s", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "same").alias("kept_sha256"), "kept_text")


def op3_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return removed_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")
