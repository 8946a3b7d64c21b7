"""Best-fit packing with bound-certified repacking.

A document's ids, with one end id after them, are cut into pieces of at most `capacity` ids (only
longer documents are cut); pieces go whole into sequences of at most `capacity` ids. Only lengths
matter for that: pieces are dealt to partitions by their row, each partition packs the histogram of
its lengths by best-fit decreasing, and dual-feasible functions give a lower bound of its number of
bins. Where bins and bound differ, the partition gives its emptiest bins back; the pieces of eight
neighbouring partitions meet in one of the next level and best-fit decreasing runs again, until one
partition is left. Lengths are integers up to `capacity`, so a partition's histogram is bounded and no
task holds more than `partition_pieces` pieces (at the last levels: what was given back).

The tokenizer is a file of the `tokenizers` library, named by path and read once in each worker. For
texts of Latin characters its normaliser and word pattern are applied here, a column at a time, and the
ids of a bounded number of runs between blanks are remembered by the worker; all other texts, and texts
that may hold special tokens, go through the library whole.

Defined results: a null or empty text is one piece that holds the end id alone; a very long text is
cut into pieces; repeated rows are packed each for itself; an empty table gives no row; other columns
are ignored. Ties between equal lengths are broken by row.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import steps, stored, text_bytes

CAPACITY = 4096
END_ID = 1
PARTITION_PIECES = 1 << 16
FAN_IN = 8
#: Runs whose ids a worker remembers, in each of two generations, and bytes of text whose runs are looked up at once.
REMEMBERED, TEXT_STEP = 50_000, 1 << 24

# ---------------------------------------------------------------- tokens

#: ASCII, Latin-1 and Latin Extended-A: lower-casing stays among them, and they compose with nothing.
_LATIN = range(0x180)


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in _LATIN if test(c))


_BLANK = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}
_LETTER = _class(lambda c: unicodedata.category(chr(c))[0] == "L")
_NUMBER = _class(lambda c: unicodedata.category(chr(c))[0] == "N")
_REST = _class(lambda c: unicodedata.category(chr(c))[0] not in "LN" and c not in _BLANK)
#: The tokenizer's own word pattern, over Latin characters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[{_REST}]+")
#: Texts with other characters, a capital that lower-cases to two, a separator that Python takes for a blank
#: and the tokenizer does not, or a possible special token.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u017f]|<\\|")


#: The same for Arrow's expressions.
_OTHER_ARROW = r"[^\x00-\x1b\x20-\x{12f}\x{131}-\x{17f}]|<\|"
#: The tokenizer's characters for the bytes of a word: those that print stand for themselves.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}


class WordIds(dict):
    """Ids, as little-endian bytes, of runs of characters without a blank: a word never spans a blank. When the
    runs of this generation fill it, it becomes the old one; runs that are met again move over."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.tokens = self.tokenizer.model.tokenize

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.word(run) if run.isalpha() else b"".join(map(self.word, _PIECES.findall(run)))
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[run] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word in lower case, by the tokenizer's merges."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        coded = [token.id for token in self.tokens(word)]
        return struct.pack(f"<{len(coded)}I", *coded)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        return self.whole(text) if _OTHER.search(text) else b"".join(map(self.__getitem__, text.lower().split()))

    def of_texts(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column without nulls, `end` after each, and where each one's end. A run is
        looked up once, however often the column has it."""
        other = pc.match_substring_regex(texts, _OTHER_ARROW)
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(other, "", texts)))
        runs, after = split.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(split).to_numpy())
        coded = list(map(self.__getitem__, runs.dictionary.to_pylist()))
        apart = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        coded += [end, *(self.whole(texts[i].as_py()) + end for i in apart.tolist())]
        last = np.full(len(texts), len(runs.dictionary), np.int32)
        last[apart] += np.arange(1, len(apart) + 1, dtype=np.int32)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        code = np.insert(runs.indices.to_numpy(), after, last)
        n = size[code]
        upto = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[code] - (upto - n), n)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(coded), "<u4")[place], upto[after + np.arange(len(texts))]


@functools.cache
def word_ids(path: str) -> WordIds:
    """The runs that this worker remembers, from one task to the next."""
    return WordIds(path)


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = word_ids(tokenizer_path)
        for batch in batches:
            rows, names, texts = ([], [], [], [], []), batch.column(0), batch.column(1).fill_null("")
            for a, b in steps(text_bytes(texts)[1], TEXT_STEP):
                ids, ends = words.of_texts(texts.slice(a, b - a), end)
                raw, begin = memoryview(ids).cast("B"), 0
                for i, stop in enumerate(ends.tolist(), a):
                    for piece, at in enumerate(range(begin, stop, capacity)):
                        to = min(at + capacity, stop)
                        for column, value in zip(rows, (i, piece, at - begin, to - at, zlib.crc32(raw[4 * at : 4 * to]))):
                            column.append(value)
                    begin = stop
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in rows[2:]]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- bins


def best_fit_decreasing(lengths: list[int], counts: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of lengths: each item, longest first, goes to the fullest bin that can take it."""
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r left
    bins: list[list[int]] = []
    for length, count in sorted(zip(lengths, counts), reverse=True):
        for _ in range(count):
            fitting = rooms >> length
            if fitting:
                room = (fitting & -fitting).bit_length() - 1 + length
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, at = capacity, len(bins)
                bins.append([])
            bins[at].append(length)
            left = room - length
            if left:
                by_room.setdefault(left, []).append(at)
                rooms |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """The best of several dual-feasible bounds on the number of bins, not rounded: the plain volume,
    u_k (x where (k+1)x is whole, else floor((k+1)x)/k) and U_e (long items count 1, short ones 0)."""
    x, n, c = lengths.astype(np.int64), counts.astype(np.int64), capacity
    best = float((x * n).sum() / c)
    for k in range(1, 33):
        scaled = x * (k + 1)
        u = np.where(scaled % c == 0, x / c, (scaled // c) / k)
        best = max(best, float((u * n).sum()))
    for e in np.unique(np.minimum(x, c - x)):
        if 0 < 2 * e <= c:
            u = np.where(x > c - e, 1.0, np.where(x < e, 0.0, x / c))
            best = max(best, float((u * n).sum()))
    return best


def _pack_partition(key, frame: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """Places for one partition's lengths: rows (part, length, nth, bin, offset); bin -1 gives back."""
    lengths, counts = frame["length"].to_numpy(), frame["n"].to_numpy()
    bins = best_fit_decreasing(lengths.tolist(), counts.tolist(), capacity)
    room = capacity - np.array([sum(b) for b in bins])
    give = np.zeros(len(bins), bool)
    gap = len(bins) - lower_bound(lengths, counts, capacity)
    if not last and gap > 0:
        worst = np.argsort(-room, kind="stable")[: 4 * int(np.ceil(gap)) + 4]
        give[worst] = room[worst] > 0
    seen = dict.fromkeys(lengths.tolist(), 0)
    out = []
    for b, items in enumerate(bins):
        at = 0
        for length in items:
            out.append((length, seen[length], -1 if give[b] else b, at))
            seen[length] += 1
            at += length
    placed = pd.DataFrame(out, columns=["length", "nth", "bin", "offset"])
    placed.insert(0, "part", np.int64(key[0]))
    return placed


def _packer(capacity: int, last: bool):
    def run(key, frame):
        return _pack_partition(key, frame, capacity, last)

    return run


def packed(cut: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES,
           fan_in: int = FAN_IN) -> DataFrame:
    """`cut` (rows with a `length` of 1 to capacity) with sequence_id and offset. A piece that fills a
    sequence has one of its own."""
    rows = stored(cut.withColumn("__pid", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in rows.columns if c != "__pid"]
    full = rows.where(F.col("length") == capacity).select(
        *columns, (-F.col("__pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity).select("__pid", "length")
    n = rest.count()
    parts, level, done = max(1, -(-n // partition_pieces)), 0, []
    left = rest.withColumn("part", F.pmod(F.xxhash64("__pid"), F.lit(parts)))
    while True:
        last = parts == 1
        hist = left.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        places = hist.groupBy("part").applyInPandas(
            _packer(capacity, last), "part long, length long, nth long, bin long, offset long")
        nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("__pid")) - 1
        found = stored(left.withColumn("nth", nth).join(places, ["part", "length", "nth"]).select(
            "__pid", "length", "part", "bin", "offset"), f"packed-{level}")
        done.append(found.where("bin >= 0").select(
            "__pid", "offset", (F.lit(level << 56) + F.col("part") * (1 << 28) + F.col("bin")).alias("sequence_id")))
        if last:
            break
        parts, level = -(-parts // fan_in), level + 1
        left = found.where("bin < 0").select("__pid", "length", F.expr(f"part div {fan_in}").alias("part"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return full.unionByName(rows.join(placed, "__pid").select(*columns, "sequence_id", "offset"))


def packed_documents(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
                     end_id: int = END_ID, **options) -> DataFrame:
    """Every piece of every document with its sequence and place. The tokenizer's path defaults to the
    installed public one."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    cut = packed(pieces(documents, tokenizer_path, capacity, end_id), capacity, **options)
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return packed_documents(read_table(spark, sf_dir, "documents"))
