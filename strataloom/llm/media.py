"""Media columns: AVI motion-JPEG. RIFF indexes are parsed, intra frames decoded, and shots found by
adaptive histogram differences, which yields timed clip rows.

Stored form. A payload byte is one 8-bit grey sample, shown as one flat 8 x 8 block of a baseline
JPEG frame of 16 x 12 blocks (128 x 96 pixels, 192 samples). The quantiser is 8 for every
coefficient, so the block's DC coefficient is the sample minus 128 and decoding is exact. The DC
Huffman table gives category c a code of 16 - c bits: a code with its extra bits always takes 16
bits, the end-of-block code takes 8, and the scan can be read as arrays. The container is RIFF AVI
with `hdrl`, `movi` and an `idx1` index.

Reading. Frames of this kind are decoded as arrays, many at once. Any other baseline JPEG - other tables,
AC coefficients, colour, restart markers - goes through `jpeg.luminance`, and each of its 8 x 8 blocks
counts with its mean. `video_clips` takes videos as they are.

Defined results: null and empty texts are stored as one frame of blanks; one very long text is one
long video; repeated rows and equal texts give equal values; an empty table gives no row. A frame of a
foreign video that cannot be decoded, or differs in size, stands for the one before it (the first: grey 0) and
is counted; a file that is no AVI, null or has no frame gives one row with an `error` and no clip. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import jpeg
from strataloom.llm.common import text_bytes

BLOCKS_WIDE, BLOCKS_HIGH = 16, 12
SAMPLES = BLOCKS_WIDE * BLOCKS_HIGH
FRAMES_PER_SECOND = 24
QUANTISER = 8
_EOB = 0x00
#: Frames that are coded or decoded together.
_STEP_FRAMES = 2048


# ---------------------------------------------------------------- Huffman tables


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits) of the canonical code with these bit lengths."""
    code, bits, out = 0, 0, {}
    for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[symbol] - bits
        bits = lengths[symbol]
        out[symbol] = (code, bits)
        code += 1
    return out


_DC_LENGTHS = {c: 16 - c for c in range(9)}
_AC_LENGTHS = {_EOB: 8}


def _code_words() -> np.ndarray:
    """The 16 bits that stand for each DC difference -255..255 (entry difference + 255)."""
    codes, out = _canonical(_DC_LENGTHS), np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << c) - 1
        out[d + 255] = codes[c][0] << c | (extra if c else 0)
    return out


_WORDS = _code_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(symbols))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0")
    + _segment(0xDB, b"\0" + bytes([QUANTISER] * 64))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0))
    + _dht(0x00, _DC_LENGTHS)
    + _dht(0x10, _AC_LENGTHS)
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


# ---------------------------------------------------------------- writing


def pad(raw: bytes) -> bytes:
    """Blanks are appended up to a positive multiple of one frame's samples."""
    short = -len(raw) % SAMPLES if raw else SAMPLES
    return raw + b" " * short


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of (frames, SAMPLES) 8-bit samples."""
    level = samples.astype(np.int16) - 128
    steps = np.diff(level, axis=1, prepend=np.int16(0))
    words = _WORDS[steps + 255]
    scan = np.zeros((*words.shape, 3), np.uint8)
    scan[..., 0], scan[..., 1] = words >> 8, words & 255  # the third byte is the end-of-block code 0
    scan = scan.reshape(len(samples), -1)
    stuffed = (scan == 255).any(axis=1)
    out = []
    for row, escape in zip(scan, stuffed.tolist()):
        data = row.tobytes()
        out.append(_HEAD + (data.replace(b"\xff", b"\xff\x00") if escape else data) + b"\xff\xd9")
    return out


def write_avi(payload: bytes) -> bytes:
    """An AVI of a payload whose length is a multiple of SAMPLES."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    n, wide, high = len(samples), BLOCKS_WIDE * 8, BLOCKS_HIGH * 8
    parts, sizes = [b"movi"], np.empty(n, np.int64)
    for a in range(0, n, _STEP_FRAMES):
        for k, image in enumerate(encode_frames(samples[a : a + _STEP_FRAMES]), a):
            sizes[k] = len(image)
            parts.append(b"00dc" + struct.pack("<I", len(image)) + image + b"\0" * (len(image) & 1))
    movi = b"".join(parts)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    stride = 8 + sizes + (sizes & 1)
    index[:, 2], index[:, 3] = 4 + np.cumsum(stride) - stride, sizes
    largest = int(sizes.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, n, 0, 1,
                       largest, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, largest,
                                     0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    strl = _list(b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    body = b"AVI " + _list(b"hdrl" + _chunk(b"avih", avih) + strl) + _list(movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(body: bytes) -> bytes:
    return _chunk(b"LIST", body)


# ---------------------------------------------------------------- reading


class Avi:
    """What the RIFF tree says: frames per second, size in pixels, and the place and length of each
    video frame from the index (or, without one, from walking `movi`)."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not a RIFF AVI")
        self.data, self.fps, self.width, self.height = data, 0.0, 0, 0
        self.movi, index = None, None
        for name, a, b in self._walk(12, min(len(data), 8 + self._u32(4))):
            if name == b"avih":
                period = self._u32(a)
                self.fps = 1e6 / period if period else 0.0
                self.width, self.height = self._u32(a + 32), self._u32(a + 36)
            elif name == b"strh" and data[a : a + 4] == b"vids":
                scale, rate = self._u32(a + 20), self._u32(a + 24)
                self.fps = rate / scale if scale else self.fps
            elif name == b"movi":
                self.movi = (a, b)
            elif name == b"idx1":
                index = (a, b)
        if self.movi is None:
            raise ValueError("no movi list")
        if index is not None:
            rows = np.frombuffer(data, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
            rows = rows[(rows[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
            # Offsets count from the word `movi`, or in some files from the file's start.
            base = self.movi[0] - 4
            if len(rows) and data[base + int(rows[0, 2]) : base + int(rows[0, 2]) + 4][2:] != b"dc":
                base = 0
            self.places = rows[:, 2].astype(np.int64) + base + 8
            self.lengths = rows[:, 3].astype(np.int64)
        else:
            found = [(a, b) for name, a, b in self._walk(*self.movi) if name[2:] == b"dc"]
            self.places = np.array([a for a, _ in found], np.int64)
            self.lengths = np.array([b - a for a, b in found], np.int64)

    def _u32(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def _walk(self, at: int, end: int):
        """Chunks as (name, body start, body end); lists are entered, `movi` is only named."""
        while at + 8 <= end:
            name, size = self.data[at : at + 4], self._u32(at + 4)
            if name == b"LIST":
                kind = self.data[at + 8 : at + 12]
                if kind == b"movi":
                    yield b"movi", at + 12, at + 8 + size
                else:
                    yield from self._walk(at + 12, at + 8 + size)
            else:
                yield name, at + 8, min(at + 8 + size, end)
            at += 8 + size + (size & 1)

    def frames(self):
        view = self.data
        for a, n in zip(self.places.tolist(), self.lengths.tolist()):
            yield view[a : a + n]


class _Head:
    """A parsed JPEG header of flat blocks: size, quantiser and a table from 16 bits to a DC difference."""

    def __init__(self, head: bytes):
        at, tables = 2, {}
        self.quantiser = self.wide = self.high = 0
        while at < len(head):
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                self.quantiser = body[1]
            elif marker == 0xC0:
                self.high, self.wide = struct.unpack_from(">HH", body, 1)
            elif marker == 0xC4:
                counts, symbols = body[1:17], body[17:]
                lengths, k = {}, 0
                for bits, count in enumerate(counts, 1):
                    for _ in range(count):
                        lengths[symbols[k]] = bits
                        k += 1
                tables[body[0]] = lengths
            elif marker == 0xDA:
                break
            at += 2 + size
        dc, ac = tables.get(0x00), tables.get(0x10)
        if not dc or not ac or any(bits + c != 16 for c, bits in dc.items()) or ac != {_EOB: 8}:
            raise ValueError("a scan that is not of flat blocks in 24 bits")
        self.difference = np.full(1 << 16, 32767, np.int16)
        for c, (code, _) in _canonical(dc).items():
            extra = np.arange(1 << c)
            value = np.where(extra >> max(0, c - 1) & 1, extra, extra - (1 << c) + 1) if c else np.zeros(1)
            self.difference[(code << c) + extra] = value


def _scan_start(image: bytes) -> int:
    """Where the entropy-coded data begin; segments are walked by their lengths."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at = 2
    while at + 4 <= len(image):
        if image[at] != 255:
            break
        marker, size = image[at + 1], image[at + 2] << 8 | image[at + 3]
        at += 2 + size
        if marker == 0xDA:
            return at
    raise ValueError("a JPEG image without a scan")


def _flat_head(head: bytes) -> _Head | None:
    """None where the header is not that of flat blocks coded by 24 bits each."""
    try:
        return _Head(head)
    except (ValueError, IndexError, struct.error):
        return None


class Decoder:
    """Decodes intra frames; headers that repeat from frame to frame are parsed once."""

    def __init__(self):
        self.heads: dict[bytes, _Head] = {}
        self.last = b""

    def samples(self, images: list[bytes]) -> np.ndarray:
        """(frames, blocks) 8-bit samples: the grey value of each flat block, or each block's mean."""
        scans, head = [], None
        for image in images:
            n = len(self.last)
            if not n or image[:n] != self.last:
                n = _scan_start(image)
                self.last = image[:n]
            if self.last not in self.heads:
                self.heads[self.last] = _flat_head(self.last)
            own = self.heads[self.last]
            if own is None:
                return self._others(images)
            if head is not None and (own.wide, own.high) != (head.wide, head.high):
                raise ValueError("frames of different sizes")
            head = own
            data = image[n : image.rindex(b"\xff\xd9")]
            scans.append(data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data)
        blocks = (head.wide // 8) * (head.high // 8)
        coded = np.frombuffer(b"".join(scans), np.uint8)
        if coded.size != len(images) * blocks * 3:
            raise ValueError("a truncated scan")
        coded = coded.reshape(len(images), blocks, 3)
        steps = head.difference[coded[..., 0].astype(np.uint16) << 8 | coded[..., 1]]
        level = np.cumsum(steps, axis=1, dtype=np.int32)
        if coded[..., 2].any() or (steps == 32767).any():
            raise ValueError("a corrupt scan")
        return np.clip((level * head.quantiser >> 3) + 128, 0, 255).astype(np.uint8)


    def _others(self, images: list[bytes]) -> np.ndarray:
        frames = [jpeg.block_means(jpeg.luminance(image)) for image in images]
        if len({len(f) for f in frames}) > 1:
            raise ValueError("frames of different sizes")
        return np.array(frames)

    def lenient(self, images: list[bytes]) -> tuple[np.ndarray, int]:
        """The samples of what can be decoded; frames that cannot stand for the one before. Their number."""
        try:
            return self.samples(images), 0
        except ValueError:
            pass
        frames, bad, size = [], 0, 0
        for image in images:
            try:
                own = self.samples([image])[0]
                size = size or len(own)
                if len(own) != size:
                    raise ValueError("frames of different sizes")
                frames.append(own)
            except ValueError:
                frames.append(frames[-1] if frames else None)
                bad += 1
        blank = np.zeros(size or 1, np.uint8)
        return np.array([blank if f is None else f for f in frames]), bad


def read_samples(avi: Avi, decoder: Decoder | None = None) -> np.ndarray:
    decoder, out, step = decoder or Decoder(), [], []
    for image in avi.frames():
        step.append(image)
        if len(step) == _STEP_FRAMES:
            out.append(decoder.samples(step))
            step = []
    if step:
        out.append(decoder.samples(step))
    return np.concatenate(out) if out else np.zeros((0, SAMPLES), np.uint8)


# ---------------------------------------------------------------- shots


def shot_starts(samples: np.ndarray, bins: int = 16, window: int = 12, k: float = 3.0, floor: float = 0.25) -> np.ndarray:
    """First frames of the shots. The distance of neighbouring frames is half the L1 difference of
    their grey histograms (0 to 1); a cut is a distance over `floor` that exceeds the mean of the
    `window` distances before it by `k` of their standard deviations."""
    n = len(samples)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    place = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * bins
    counts = np.bincount(place.ravel(), minlength=n * bins).reshape(n, bins) / samples.shape[1]
    apart = np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2
    sums = np.concatenate([[0.0], np.cumsum(apart)])
    squares = np.concatenate([[0.0], np.cumsum(apart * apart)])
    i = np.arange(n - 1)
    a = np.maximum(0, i - window)
    seen = np.maximum(i - a, 1)
    mean = (sums[i] - sums[a]) / seen
    spread = np.sqrt(np.maximum((squares[i] - squares[a]) / seen - mean * mean, 0.0))
    cut = (apart > floor) & (apart > mean + k * spread) & (i > 0)
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def store_text(raw: bytes) -> bytes:
    return write_avi(pad(raw))


def clips(documents: DataFrame) -> DataFrame:
    """Timed clip rows of the videos of `documents` (doc_id, text): doc_id, clip, first_frame,
    frames, start_s, end_s, mean_grey."""

    def run(batches):
        decoder = Decoder()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows, ids = [], batch.column(0)
            for i in range(batch.num_rows):
                avi = Avi(store_text(data[offsets[i] : offsets[i + 1]].tobytes()))
                samples = read_samples(avi, decoder)
                starts = shot_starts(samples)
                for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(samples)])):
                    rows.append((i, c, int(a), int(b - a), a / avi.fps, b / avi.fps, float(samples[a:b].mean())))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]],
                ["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "mean_grey"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, clip long, first_frame long, frames long, start_s double, end_s double, mean_grey double")


def video_clips(videos: DataFrame, key: str, data: str) -> DataFrame:
    """Timed clip rows of AVI files in a binary column: the key, clip, first_frame, frames, start_s, end_s,
    mean_grey, width, height, bad_frames and error."""

    def rows_of(raw: bytes | None, decoder: Decoder) -> list[tuple]:
        try:
            avi = Avi(raw or b"")
            if not len(avi.places):
                raise ValueError("no video frame")
            samples, bad = decoder.lenient(list(avi.frames()))
        except (ValueError, struct.error, IndexError) as e:
            return [(*[None] * 9, str(e) or "corrupt")]
        fps = avi.fps if avi.fps > 0 else float(FRAMES_PER_SECOND)
        starts = shot_starts(samples)
        return [(c, int(a), int(b - a), float(a / fps), float(b / fps), float(samples[a:b].mean()), avi.width, avi.height, bad, None)
                for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(samples)]))]

    names = ["clip", "first_frame", "frames", "start_s", "end_s", "mean_grey", "width", "height", "bad_frames", "error"]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()] * 3 + [pa.string()]

    def run(batches):
        decoder = Decoder()
        for batch in batches:
            found = [rows_of(raw, decoder) for raw in batch.column(1).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            cols = list(zip(*(r for f in found for r in f))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["key", *names])

    sent = videos.select(F.col(key).alias("key"), F.col(data).alias("data"))
    types = ["long"] * 3 + ["double"] * 3 + ["long"] * 3 + ["string"]
    out = sent.mapInArrow(run, f"key {sent.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    return out.select(F.col("key").alias(key), *names)


def media_columns(documents: DataFrame) -> DataFrame:
    """Each text stored as a video and read back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        decoder = Decoder()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                media = store_text(raw)
                avi = Avi(media)
                samples = read_samples(avi, decoder)
                payload = samples.tobytes()
                starts = shot_starts(samples)
                longest = int(np.diff(np.append(starts, len(samples))).max())
                feature = (f"mjpeg {avi.width}x{avi.height}@{avi.fps:g} frames={len(samples)} shots={len(starts)} "
                           f"longest={longest} seconds={len(samples) / avi.fps:.3f} grey={samples.mean():.4f}")
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                            len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                 "feature"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
             "media_bytes long, media_sha256 string, feature string")


def op9_query(spark, sf_dir):
    from strataloom.llm.common import read_table

    return media_columns(read_table(spark, sf_dir, "documents"))
