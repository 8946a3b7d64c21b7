"""SimHash near-duplicates with pigeonring filtering.

Fingerprint. Words are runs of bytes other than blanks (0x20, 0x09-0x0D) after A-Z is lower-cased;
shingles are runs of `words` words joined by single spaces, repeats included; a text of fewer words
is one shingle, a text without words has fingerprint zero. A bit is 1 if it is set in over half of
the shingles' XXH64 values (seed 42).

Links within a Hamming distance. The 64 bits form a ring of m segments. If two fingerprints differ in
at most t bits, some segment starts a chain in which the first j segments together differ in at most
j * t / m bits, for every j up to m. While j * t / m < 1 the segments must be equal, so these first
segments are the key of an equi-join, one key for each start; the longer prefixes of the chain prune
what the join found, and the full Hamming check comes last. Keys that more than `max_bucket`
fingerprints share would give pairs by the square of their number. Those fingerprints take an exact
other way: two words of 64 bits are within 2 bits if and only if some centre is within 1 bit of
both, so each is filed under itself and its 64 neighbours and every member of a file is linked to
the file's smallest one. A file has 65 members at most, so no group is large; distances over 2 use
the same step with more neighbours (`max_hamming // 2` flips from one side, the rest from the other).

Equal fingerprints are one node. Components are found by star contraction over fingerprints.

Near-duplicates by similarity. `near_duplicates` links texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. There the bits of the fingerprint are laid out by shingle class:
a shingle belongs to one of c classes by its hash, each class has a 64-bit SimHash of its own, and
these are the ring's segments. Two sets of n shingles with similarity s differ in at most
2n(1-s)/(1+s) shingles, so with more classes than that some segment is untouched and equal; texts with
too few filled classes add their least shingles as keys, so that no pair so alike is missed. The keys of
the first classes find nearly all; those of the others are then looked through for keys whose members
still lie in different groups (`_late_links`). Candidates are verified by the exact similarity of the sets. Keys of more than `max_paired` texts first give stars and pairs of longer chains;
where these leave such a key's members in several groups, all members of different groups are compared
by parity sketches, block by block, and what the sketches allow is verified (`_crowded_links`).

Defined results: null and empty texts have fingerprint zero and are linked with each other (in
`near_duplicates` they form one group too); repeated rows share a fingerprint and a component; a null
`doc_id` never names a component unless all of it are null; an empty table gives no row; other
columns are ignored by `simhash_components` and kept by `near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import Hidden, components, dropped, mix64, released, steps, stored, stored_by, text_bytes
from strataloom.llm.words import LOWER, UNBLANK, word_bounds

SEED = 42
SEGMENTS = 9
MAX_HAMMING = 2
MAX_BUCKET = 32


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, row after row, and the number of shingles of each row."""
    low = LOWER[data]
    keep = UNBLANK[low]
    starts, ends, before = word_bounds(low, offsets, UNBLANK)
    counts = np.diff(before)
    # The text with one blank after each word: a shingle is a slice of it.
    size = ends - starts
    place = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.full(int(place[-1]), 32, np.uint8)
    target = np.ones(len(flat), bool)
    target[place[1:] - 1] = False
    flat[target] = low[keep]
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), shingles)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = before[row] + nth
    last = np.minimum(first + words, before[row + 1])
    view, digest = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    spans = zip(place[first].tolist(), (place[last] - 1).tolist())
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(row))
    return hashes, shingles


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit word for each run of `counts` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    ends = np.cumsum(counts)
    cut, a = 1 << 18, 0
    while a < len(filled):  # bits of about `cut` hashes at a time
        begin = ends[filled[a]] - counts[filled[a]]
        b = max(a + 1, int(np.searchsorted(ends[filled], begin + cut, side="right")))
        rows = filled[a:b]
        if b == a + 1 and counts[rows[0]] > cut:
            ones = sum(_bits(hashes[i : i + cut]).sum(axis=0, dtype=np.int64)
                       for i in range(begin, ends[rows[0]], cut))[None]
        else:
            ones = np.add.reduceat(_bits(hashes[begin : ends[rows[-1]]]), ends[rows] - counts[rows] - begin, axis=0,
                                   dtype=np.int32)
        major = np.packbits(ones * 2 > counts[rows][:, None], axis=1)
        out[rows] = major.view(">u8")[:, 0]
        a = b
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """Column `fp` (the 64 bits as a signed long) beside doc_id, for every row."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = [np.zeros(0, np.uint64)]
            for a, b in steps(offsets):
                hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                out.append(bit_majorities(hashes, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(out).view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- pigeonring


def ring(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the segments; widths differ by one at most."""
    edge = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _mask(parts: list[tuple[int, int]]) -> int:
    m = sum(((1 << n) - 1) << a for a, n in parts)
    return m - (1 << 64) if m >> 63 else m


def chain_keys(segments: int, distance: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """For each start: the mask of the segments that must be equal, and (mask, budget) of the longer
    prefixes of its chain."""
    parts = ring(segments)
    masks, budgets = [], []
    for start in range(segments):
        chain = [parts[(start + j) % segments] for j in range(segments)]
        equal = max(j for j in range(1, segments + 1) if j * distance < segments)
        masks.append(_mask(chain[:equal]))
        budgets.append([(_mask(chain[:j]), j * distance // segments) for j in range(equal + 1, segments)])
    return masks, budgets


def hamming_links(nodes: DataFrame, distance: int = MAX_HAMMING, segments: int = SEGMENTS,
                  max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) that connect exactly the pairs of distinct fingerprints `fp` within `distance`
    bits: pairs themselves, or for crowded keys paths through a fingerprint near both."""
    if distance * 2 >= segments:
        raise ValueError("the ring needs more than twice as many segments as differing bits")
    masks, budgets = chain_keys(segments, distance)
    keyed = nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("start", "key"))
    crowd = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(crowd, "simhash-keys")
    few = shared.where(F.col("n") <= max_bucket).select("start", "key")
    left = keyed.join(few, ["start", "key"])
    a, b = left.alias("a"), left.alias("b")
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.fp") < F.col("b.fp")))
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    viable = F.lit(False)
    for start, prefixes in enumerate(budgets):
        ok = F.col("a.start") == start
        for mask, most in prefixes:
            ok = ok & (F.bit_count(apart.bitwiseAND(F.lit(mask))) <= most)
        viable = viable | ok
    close = pairs.where(viable).where(F.bit_count(apart) <= distance)
    links = close.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if shared.where(F.col("n") > max_bucket).isEmpty():
        return links
    many = shared.where(F.col("n") > max_bucket).select("start", "key")
    crowded = keyed.join(many, ["start", "key"]).select("fp").distinct()
    return links.unionByName(_files(crowded, distance))


def _files(nodes: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints within `distance` <= 2 bits through shared centres; no pair of a crowded
    key is enumerated."""
    if distance > 2:
        raise ValueError("crowded keys are resolved for distances up to 2")
    flips = [0] + ([_mask([(i, 1)]) for i in range(64)] if distance else [])
    filed = nodes.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in flips])).alias("centre"))
    # At distance 1 a centre would join two that are 2 apart: there only a member's own file counts.
    if distance == 1:
        own = nodes.select(F.col("fp").alias("centre"))
        return filed.join(own, "centre").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    lowest = filed.groupBy("centre").agg(F.min("fp").alias("v"), F.max("fp").alias("w"), F.collect_list("fp").alias("m"))
    return lowest.where("v <> w").select(F.explode("m").alias("u"), "v").where("u <> v")


def simhash_components(documents: DataFrame, words: int = 3, distance: int = MAX_HAMMING,
                       segments: int = SEGMENTS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that
    links of at most `distance` bits reach, itself included."""
    prints = stored(fingerprints(documents, words), "simhash-fp")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = stored(hamming_links(nodes.select("fp"), distance, segments, max_bucket), "simhash-links")
    roots = components(links)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return simhash_components(read_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- near-duplicates by similarity

SIMILARITY = 0.8
#: Classes whose keys give the first candidates; those of the others come second.
FIRST_CLASSES = 12
#: Members of a key that are paired by a join; more go by longer chains and stars, then by sketches.
MAX_PAIRED = 8
#: Bits of a parity sketch, and those of its first part, which is looked at first.
SKETCH_BITS, GLANCE_BITS = 4096, 1024
#: Members of a crowded key that one task compares with as many others.
BLOCK = 4096
#: Spanning forests of a crowded key's allowed pairs that the first round verifies.
FIRST_FORESTS = 4
#: Keys that are packed at once (one text's keys more, at most), and shingles for each part they are dealt to.
KEY_ROWS, PART_SHINGLES = 1 << 20, 1 << 20


def class_count(scale: int, similarity: float) -> int:
    """Classes for sets of 2**scale to 2**(scale + 1) / similarity shingles: one more than the shingles in
    which two of them can differ at this similarity."""
    largest = 2 ** (scale + 1) / similarity
    return int(2 * largest * (1 - similarity) / (1 + similarity)) + 1


def segment_keys(hashes: np.ndarray, similarity: float = SIMILARITY, first: int = FIRST_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one text's segments, those of the `first` classes and those of the others: for each scale
    that the text shares with sets of similar size, the SimHash of each class of its distinct shingles
    (sorted `hashes`), tagged with scale and class.

    If more classes hold a shingle than a set that is alike can differ in, one of them is untouched, and its
    key equal. A text may have fewer; if so, it also gets its least shingles, of which two sets so alike
    share one. Two sets that both have fewer are found by these, all others by a class."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    scale = n.bit_length() - 1
    # With each scale the largest set that is found by it.
    scales = [(scale, n / similarity)] + ([(scale - 1, 2**scale - 1)] if scale and n * similarity < 2**scale else [])
    early, late, few = [], [], False
    for s, largest in scales:
        classes = class_count(s, similarity)
        own = mix64(hashes ^ np.uint64(s + 1)) % np.uint64(classes)
        order = np.argsort(own, kind="stable")
        kind, counts = np.unique(own, return_counts=True)
        few |= len(kind) <= (n + largest) * (1 - similarity) / (1 + similarity) + 1e-9
        prints = bit_majorities(hashes[order], counts)
        with np.errstate(over="ignore"):
            keys = mix64(prints + mix64(np.uint64((s + 1) << 32) * np.uint64(0x9E3779B97F4A7C15) + kind))
        early.append(keys[kind < first])
        late.append(keys[kind >= first])
    if few:
        least = int(n - np.ceil(similarity * n - 1e-9) + 1)
        early.append(mix64(hashes[:least] ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(early), np.concatenate(late)


def _row_sets(texts, words: int):
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = text_bytes(texts)
    for a, b in steps(offsets):
        hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        ends = np.cumsum(counts)
        for end, count in zip(ends.tolist(), counts.tolist()):
            yield np.unique(hashes[end - count : end])


def _signatures(base: DataFrame, words: int, similarity: float, first: int) -> DataFrame:
    """rid, n (distinct shingles), keys (array, of the first classes) of every row."""

    def run(batches):
        for batch in batches:
            sizes, keys = [], []
            for own in _row_sets(batch.column(1), words):
                sizes.append(len(own))
                keys.append(segment_keys(own, similarity, first)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["rid", "n", "keys"])

    return base.select("rid", "text").mapInArrow(run, "rid long, n long, keys array<long>")


def _planes(x: np.ndarray) -> bytes:
    """Differences of integers, byte by byte: the many zero bytes lie together, where a shuffle packs them."""
    return np.ascontiguousarray(np.diff(x, prepend=x[:1] * 0).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def pack_keys(keys: list[np.ndarray], rid: np.ndarray, comp: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """The 48 upper bits of each row's keys, dealt to parts by key: (part, keys, places of their rows, rids,
    comps less rids). Eight bytes a key; equal keys stay equal, and a chance agreement is one more candidate."""
    order = np.argsort(rid, kind="stable")
    flat = np.concatenate([keys[i] for i in order]) >> np.uint64(16)
    row = np.repeat(np.arange(len(order)), [len(keys[i]) for i in order])
    part = flat % np.uint64(parts)
    by_part = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[by_part], np.arange(parts + 1, dtype=np.uint64))
    out = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        own = by_part[cut[p] : cut[p + 1]]
        used, at = np.unique(row[own], return_inverse=True)
        r, low = rid[order[used]], flat[own]
        out.append((p, low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype("<u2").tobytes(),
                    at.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), _planes(r), _planes(comp[order[used]] - r)))
    return out


def parted_keys(packs: list[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, rid, comp) of the packed keys of one part that rows of several components share."""
    keys, rids, comps = [], [], []
    for key, place, rid, off in packs:
        n = len(key) // 6
        keys.append(np.frombuffer(key, "<u4", n).astype(np.int64) | np.frombuffer(key, "<u2", n, 4 * n).astype(np.int64) << 32)
        r = _unplaned(rid)
        at = np.frombuffer(place, "<u2" if len(place) == 2 * n else "<u4")
        rids.append(r[at])
        comps.append((r + _unplaned(off))[at])
    key, rid, comp = (np.concatenate(x) for x in (keys, rids, comps))
    order = np.argsort(key)
    key, rid, comp = key[order], rid[order], comp[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
    keep = np.repeat(several, np.diff(np.append(first, len(key))))
    return key[keep], rid[keep], comp[keep]


def _late_members(placed: DataFrame, words: int, similarity: float, first: int, parts: int) -> DataFrame:
    """(key, rid, comp) for the keys of the other classes that rows (rid, comp, text) of several components share.
    Keys go through one shuffle, packed; only those that part components become rows."""

    def pack(batches):
        for batch in batches:
            rid, comp = (batch.column(k).to_numpy() for k in (0, 1))
            keys, begin, held = [], 0, 0
            for i, own in enumerate(_row_sets(batch.column(2), words)):
                keys.append(segment_keys(own, similarity, first)[1])
                held += len(keys[-1])
                if held > KEY_ROWS or i + 1 == batch.num_rows:
                    rows = pack_keys(keys, rid[begin : i + 1], comp[begin : i + 1], parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), *[pa.binary()] * 4))],
                        ["part", "keys", "places", "rids", "offs"])
                    keys, begin, held = [], i + 1, 0

    def find(frame):
        return pd.DataFrame(dict(zip(("key", "rid", "comp"), parted_keys(list(zip(*(frame[c] for c in ("keys", "places", "rids", "offs"))))))))

    return placed.select("rid", "comp", "text").mapInArrow(
        pack, "part int, keys binary, places binary, rids binary, offs binary").groupBy("part").applyInPandas(
        find, "key long, rid long, comp long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid")))


def _texts_of(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `base` that `rows` names. Only numbers are hashed; texts are neither sorted nor, where
    `base` lies in buckets, moved."""
    return base.join(rows.select("rid").distinct().hint("shuffle_hash"), "rid", "left_semi")


def _shingle_sets(base: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [own.view(np.int64) for own in _row_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rid", "s"])

    return base.select("rid", "text").mapInArrow(run, "rid long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose sets are at least `similarity` alike."""
    both = pairs.join(sets.select(F.col("rid").alias("u"), F.col("s").alias("su")), "u").join(
        sets.select(F.col("rid").alias("v"), F.col("s").alias("sv")), "v")

    def run(batches):
        for batch in batches:
            su, sv, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = su[i].values.to_numpy(), sv[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _allowed(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) that their sketches allow to be `similarity` alike: all that are, and few others. A sketch has a
    fraction of a set's size, so that refused pairs cost a shuffle little."""
    both = pairs.join(sketches.select(F.col("rid").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su")), "u").join(
        sketches.select(F.col("rid").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv")), "v").where(
        F.least("nu", "nv") >= F.lit(similarity) * F.greatest("nu", "nv") - 1e-6)
    least = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            near = apart <= least * batch.column(4).to_numpy() + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near))

    return both.select("u", "v", "su", "sv", (F.col("nu") + F.col("nv")).alias("n")).mapInArrow(run, "u long, v long")


def _candidates(keyed: DataFrame, similarity: float, max_paired: int) -> DataFrame:
    """Pairs of rows that share a key. `keyed` has rid, n, key and chain (the key with the next ones of the
    same text's ring). A crowded key is told apart by its chain; rows that agree even in a crowded chain
    meet its smallest member. What that leaves apart is for `_crowded_links`."""
    out = None
    for level in ("key", "chain"):
        sizes = keyed.groupBy(level).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "n")).alias("low")).where("c > 1")
        few = keyed.join(sizes.where(F.col("c") <= max_paired).select(level), level).select(level, "rid", "n")
        a, b = few.alias("a"), few.alias("b")
        close = (F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n"))
        pairs = a.join(b, (F.col(f"a.{level}") == F.col(f"b.{level}")) & (F.col("a.rid") < F.col("b.rid")) & close).select(
            F.col("a.rid").alias("u"), F.col("b.rid").alias("v"))
        many = sizes.where(F.col("c") > max_paired).select(level, "low")
        crowded = keyed.join(many, level)
        star = crowded.where((F.col("rid") != F.col("low.rid")) & (
            F.least("n", F.col("low.n")) >= F.lit(similarity) * F.greatest("n", F.col("low.n")))).select(
            F.col("low.rid").alias("u"), F.col("rid").alias("v"))
        pairs = pairs.unionByName(star)
        out = pairs if out is None else out.unionByName(pairs)
        keyed = crowded.drop("low")
    return out.distinct()


def _sketches(base: DataFrame, words: int) -> DataFrame:
    """(rid, n, sketch) of every row: a bit of the sketch is the parity of the shingles that fall on it, so two
    sketches differ in at most as many bits as the sets differ in shingles."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            sizes, out = [], []
            for a, b in steps(offsets):
                hashes, counts = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                ends = np.cumsum(counts)
                for e, c in zip(ends.tolist(), counts.tolist()):
                    own = np.unique(hashes[e - c : e])
                    bits = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    sizes.append(len(own))
                    out.append(np.packbits(bits.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["rid", "n", "sketch"])

    return base.select("rid", "text").mapInArrow(run, "rid long, n long, sketch binary")


def _forests(frame, similarity: float, count: int) -> list[tuple[int, int]]:
    """Pairs of a block task's members (rid, block, comp, n, sketch, refused) that the sketches allow, that
    were not refused, and that join different components: `count` disjoint spanning forests of them. A
    task of two blocks compares members of one with members of the other."""
    frame = frame.sort_values("n", kind="stable")
    rid, n, block = (frame[c].to_numpy(np.int64) for c in ("rid", "n", "block"))
    comp = np.unique(frame["comp"].to_numpy(np.int64), return_inverse=True)[1]
    sketch = np.frombuffer(b"".join(map(bytes, frame["sketch"])), np.uint64).reshape(len(frame), -1)
    glance, two = np.ascontiguousarray(sketch[:, : GLANCE_BITS // 64]), block.min() != block.max()
    refused = [None if x is None else np.asarray(x, np.int64) for x in frame["refused"]]
    least, allowed = (1 - similarity) / (1 + similarity), []
    tops = np.searchsorted(n, n / similarity + 1e-6, side="right")
    for i in range(len(rid)):
        j = np.arange(i + 1, tops[i])
        j = j[(comp[j] != comp[i]) & (block[j] != block[i])] if two else j[comp[j] != comp[i]]
        for part in (glance, sketch):
            apart = np.bitwise_count(part[j] ^ part[i]).sum(axis=1, dtype=np.int64)
            near = apart <= least * (n[j] + n[i]) + 1e-6
            j, apart = j[near], apart[near]
        if refused[i] is not None and len(j):
            fresh = ~np.isin(rid[j], refused[i])
            j, apart = j[fresh], apart[fresh]
        if len(j):
            allowed.append((i, j[np.argsort(apart, kind="stable")]))
    out = []
    for _ in range(count):
        label, left = comp.copy(), []
        for i, j in allowed:
            other = np.flatnonzero(label[j] != label[i])
            kinds, at = np.unique(label[j[other]], return_index=True)
            taken = other[at]
            if len(taken):
                label[np.isin(label, kinds)] = label[i]
                out += [(int(rid[i]), int(rid[k])) for k in j[taken]]
                j = np.delete(j, taken)
            if len(j):
                left.append((i, j))
        allowed = left
    return out


def _forest_task(similarity: float, count: int):
    def run(frame):
        return pd.DataFrame(_forests(frame, similarity, count), columns=["u", "v"], dtype="int64")

    return run


def _crowded_links(base: DataFrame, placed: DataFrame, links: DataFrame, words: int, similarity: float,
                   block: int = BLOCK) -> DataFrame:
    """`links` and further ones, so that members (key, rid, comp) of one crowded key that are `similarity`
    alike are connected; `comp` is a member's component by `links`, and every key has members of several. Each round
    takes spanning forests of the pairs that the sketches allow, and verifies them: if none is refused, all
    allowed pairs are connected. Else two components that an allowed pair still parts are both touched by a
    refused pair of the key that lies in two components, so the next round has these alone. Refused pairs are not taken again, and the
    rounds take more forests each."""
    if placed.isEmpty():
        return links
    # One row for each text, with its keys, joins the components of every round.
    members = stored(placed.groupBy("rid").agg(F.collect_list("key").alias("keys")), "near-members")
    sketches, refused, count = stored(_sketches(_texts_of(base, members), words), "near-sketches"), None, FIRST_FORESTS
    while True:
        known = sketches.withColumn("refused", F.lit(None).cast("array<long>")) if refused is None else sketches.join(
            refused.select(F.col("u").alias("rid"), "v").unionByName(refused.select(F.col("v").alias("rid"), F.col("u").alias("v")))
            .groupBy("rid").agg(F.collect_set("v").alias("refused")), "rid", "left")
        blocks = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block")
        dealt = placed.join(blocks, "key").select("key", "rid", "comp", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "key", "rid", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        found = dealt.join(known, "rid").groupBy("key", "i", "j").applyInPandas(
            _forest_task(similarity, count), "u long, v long")
        pairs = stored(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-allowed")
        dropped(placed)
        sets = stored(_shingle_sets(_texts_of(base, _ends(pairs)), words), "near-sets")
        alike = stored(_verified(pairs, sets, similarity), "near-alike")
        dropped(sets)
        links = links.unionByName(alike)
        failed = stored(pairs.join(alike, ["u", "v"], "left_anti"), "near-refused")
        dropped(pairs)
        if not failed.isEmpty():
            refused = failed if refused is None else refused.unionByName(failed)
            count *= 8
            placed, members = _still_parted(members, _roots(links), failed)
        released(base.sparkSession)
        if failed.isEmpty() or placed.isEmpty():
            dropped(sketches)
            dropped(members)
            return links


def _still_parted(members: DataFrame, roots: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, rid, comp) of the members whose key and component a refused pair touches that has the key and lies in
    two components, and these members (rid, keys) with such keys alone."""
    now = stored(members.join(roots, "rid", "left").select("rid", "keys", F.coalesce("root", "rid").alias("comp")), "near-placed")
    ends = [now.select(F.col("rid").alias(x), F.col("keys").alias(f"k{x}"), F.col("comp").alias(f"c{x}")) for x in "uv"]
    apart = failed.join(ends[0], "u").join(ends[1], "v").where("cu <> cv").select(
        F.explode(F.array_intersect("ku", "kv")).alias("key"), F.array("cu", "cv").alias("comps"))
    touched = apart.select("key", F.explode("comps").alias("comp")).distinct()
    own = now.join(touched.select("comp").distinct(), "comp", "left_semi").select("rid", "comp", F.explode("keys").alias("key"))
    out = stored(own.join(touched, ["key", "comp"], "left_semi").select("key", "rid", "comp"), "near-crowded")
    left = stored(out.groupBy("rid").agg(F.collect_list("key").alias("keys")), "near-members")
    for done in (now, members):
        dropped(done)
    return out, left


def _late_links(base: DataFrame, single: DataFrame, tried: DataFrame, links: DataFrame, words: int, similarity: float,
                first: int, max_paired: int) -> DataFrame:
    """`links` and further ones, so that members of one key of the later classes that are alike are connected.
    Only keys whose members lie in several components matter. `tried` pairs are known."""
    comps = single.select("rid", "n").join(_roots(links), "rid", "left").select("rid", "n", F.coalesce("root", "rid").alias("comp"))
    held = stored(comps, "near-late-placed")
    parts = max(1, (held.agg(F.sum("n")).first()[0] or 0) // PART_SHINGLES)
    members = stored(_late_members(base.join(held.drop("n").hint("shuffle_hash"), "rid"), words, similarity, first, parts), "near-late-members")
    released(base.sparkSession)
    if not members.isEmpty():
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        few = members.join(sizes.where(F.col("c") <= max_paired).select("key"), "key")
        a, b = few.alias("a"), few.alias("b")
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & (F.col("a.comp") != F.col("b.comp"))).select(
            F.col("a.rid").alias("u"), F.col("b.rid").alias("v")).distinct()
        fresh = stored(pairs.join(tried, ["u", "v"], "left_anti"), "near-late-pairs")
        sketches = stored(_sketches(_texts_of(base, _ends(fresh)), words), "near-sketches")
        allowed = stored(_allowed(fresh, sketches, similarity), "near-late-allowed")
        sets = stored(_shingle_sets(_texts_of(base, _ends(allowed)), words), "near-sets")
        links = links.unionByName(stored(_verified(allowed, sets, similarity), "near-late-links"))
        crowded = stored(members.join(sizes.where(F.col("c") > max_paired).select("key"), "key"), "near-crowded")
        for done in (fresh, sketches, allowed, sets):
            dropped(done)
        released(base.sparkSession)
        links = _crowded_links(base, crowded, links, words, similarity)
    dropped(members)
    dropped(held)
    return links


def _roots(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("rid"), "root")


def _in_several(placed: DataFrame, more_than: int) -> DataFrame:
    """Rows (key, rid, comp) of the keys of more than `more_than` members that lie in several components."""
    parted = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where(
        (F.col("c") > more_than) & (F.col("x") != F.col("y"))).select("key")
    return placed.select("key", "rid", "comp").join(parted, "key")


def near_duplicates(base: DataFrame, words: int = 5, similarity: float = SIMILARITY, first: int = FIRST_CLASSES,
                    max_paired: int = MAX_PAIRED) -> DataFrame:
    """(rid, root) of the rows of `base` (unique rid, text) that belong to a group of two or more; root is
    the group's smallest rid. Equal texts are grouped first, and only one of them goes on."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    slim = stored(base.select("rid", digest), "near-digests")
    classes = slim.groupBy("digest").agg(F.min("rid").alias("root"), F.count(F.lit(1)).alias("c"))
    copies = slim.join(classes.where("c > 1"), "digest").select(F.col("rid").alias("u"), F.col("root").alias("v"))
    signatures = stored(_signatures(base, words, similarity, first), "near-keys")
    single = signatures.join(classes.select(F.col("root").alias("rid")), "rid")
    keyed = single.select("rid", "n", F.posexplode("keys").alias("at", "key"), "keys").select(
        "rid", "n", "key",
        F.xxhash64("key", F.element_at("keys", (F.col("at") + 1) % F.size("keys") + 1),
                   F.element_at("keys", (F.col("at") + 2) % F.size("keys") + 1)).alias("chain"))
    pairs = stored(_candidates(keyed, similarity, max_paired), "near-pairs")
    sets = stored(_shingle_sets(_texts_of(base, _ends(pairs)), words), "near-sets")
    links = stored(_verified(pairs, sets, similarity).unionByName(copies.where("u <> v")), "near-links")
    dropped(sets)
    # Every key of every text with its component: what stars and chains left apart is found by an aggregate.
    rooted = stored(single.join(_roots(links), "rid", "left").select("rid", "keys", F.coalesce("root", "rid").alias("comp")), "near-rooted")
    crowded = stored(_in_several(rooted.select("rid", "comp", F.explode("keys").alias("key")), max_paired), "near-crowded")
    dropped(rooted)
    texts = base.select("rid", "text")
    released(base.sparkSession)
    links = _crowded_links(texts, crowded, links, words, similarity)
    released(base.sparkSession)
    links = _late_links(texts, single, pairs, links, words, similarity, first, max_paired)
    for done in (signatures, slim, pairs):
        dropped(done)
    return _roots(links)


def without_near_duplicates(documents: DataFrame, words: int = 5, similarity: float = SIMILARITY, **options) -> DataFrame:
    """One document of each group of near-duplicates (the least doc_id; null ids last, then the first row),
    and all documents of no group, with all their columns."""
    hidden = Hidden(documents)
    base = stored_by(hidden.frame.withColumn("rid", F.monotonically_increasing_id()), "rid", "near-base")
    groups = near_duplicates(base.select("rid", F.col(hidden["text"]).alias("text")), words, similarity, **options)
    name = F.col(hidden["doc_id"]) if "doc_id" in hidden.names else F.col("rid")
    named = base.select("rid", name.alias("name")).join(groups, "rid")
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", "rid")).alias("s"))
    gone = stored(named.join(stays, "root").where(F.col("rid") != F.col("s.rid")).select("rid"), "near-gone")
    return hidden.restored(base.join(gone.hint("shuffle_hash"), "rid", "left_anti"))
