"""Baseline JPEG images decoded to luminance: sequential Huffman coding, 8-bit samples, one to four components
with any sampling factors, restart intervals. Tables that an image leaves out are the standard's, as frames of
motion-JPEG videos may.

Anything else - progressive, arithmetic or 12-bit coding, a truncated or corrupt scan - raises `ValueError`."""

from __future__ import annotations

import re
import struct

import numpy as np

#: The standard's Huffman tables. Counts of codes by length 1 to 16; the symbols of the shorter codes.
DC_COUNTS = {0: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], 1: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]}
AC_COUNTS = {0: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], 1: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]}
AC_SHORT = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 "
       "24 34 e1 25 f1",
}


def standard_tables() -> dict[int, tuple[list[int], list[int]]]:
    """(counts, symbols) by table class and number: 0x00 and 0x01 for DC, 0x10 and 0x11 for AC. The longest
    AC codes go to the symbols that are left, in order."""
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for k in (0, 1):
        out[k] = DC_COUNTS[k], list(range(12))
        short = [int(x, 16) for x in AC_SHORT[k].split()]
        out[0x10 | k] = AC_COUNTS[k], short + sorted(set(every) - set(short))
    return out


def zigzag() -> list[int]:
    """Place in the 8 x 8 block of each coefficient in the order of the scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = zigzag()
_k = np.arange(8)
#: Row u holds the u-th cosine of the inverse transform.
COSINES = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None]


class _Codes:
    """For the next 16 bits: the symbol whose code they begin with, and its length (0: none)."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.symbol, self.length, at, k = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int8), 0, 0
        for bits, count in enumerate(counts, 1):
            for _ in range(count):
                span = 1 << (16 - bits)
                if at + span > 1 << 16 or k >= len(symbols):
                    raise ValueError("an impossible Huffman table")
                self.symbol[at : at + span], self.length[at : at + span] = symbols[k], bits
                at, k = at + span, k + 1
        self.symbol, self.length = self.symbol.tolist(), self.length.tolist()


class _Bits:
    """A stretch of the scan between restart markers, read bit by bit."""

    def __init__(self, data: bytes):
        self.n = 8 * len(data)
        self.value = int.from_bytes(data + b"\xff\xff\xff\xff", "big")
        self.total, self.at = self.n + 32, 0

    def _peek(self, n: int) -> int:
        return self.value >> (self.total - self.at - n) & ((1 << n) - 1)

    def symbol(self, codes: _Codes) -> int:
        ahead = self._peek(16)
        length = codes.length[ahead]
        self.at += length
        if not length or self.at > self.n:
            raise ValueError("a corrupt scan")
        return codes.symbol[ahead]

    def number(self, size: int) -> int:
        """A coefficient or difference of `size` bits; those with a leading 0 are negative."""
        if not size:
            return 0
        if size > 16 or self.at + size > self.n:
            raise ValueError("a corrupt scan")
        x = self._peek(size)
        self.at += size
        return x if x >> (size - 1) else x - (1 << size) + 1


class _Component:
    def __init__(self, across: int, down: int, quantiser: int):
        self.across, self.down, self.quantiser, self.dc, self.ac = across, down, quantiser, None, None


class _Image:
    """The segments before the scan."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        self.quantisers, self.codes, self.components, self.restart = {}, {}, {}, 0
        self.order: list[_Component] = []
        for name, (counts, symbols) in standard_tables().items():
            self.codes[name] = counts, symbols
        at = 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 255:
                raise ValueError("a JPEG image without a scan")
            marker, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            try:
                self._segment(marker, body)
            except (IndexError, KeyError, struct.error) as e:
                raise ValueError("a corrupt JPEG header") from e
            if marker == 0xDA:
                break
        self.scan = data[at:]

    def _segment(self, marker: int, body: bytes) -> None:
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                n = 64 << (wide > 0)
                self.quantisers[number] = np.array(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + n]), float)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                self.codes[body[0]] = counts, list(body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            depth, self.high, self.wide, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not 1 <= n <= 4 or not self.high or not self.wide:
                raise ValueError("not an 8-bit baseline image")
            for k in range(n):
                name, sampling, quantiser = body[6 + 3 * k : 9 + 3 * k]
                if not (1 <= sampling >> 4 <= 4 and 1 <= (sampling & 15) <= 4):
                    raise ValueError("impossible sampling factors")
                self.components[name] = _Component(sampling >> 4, sampling & 15, quantiser)
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            self.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            for k in range(body[0]):
                one = self.components[body[1 + 2 * k]]
                one.dc, one.ac = (_Codes(*self.codes[t]) for t in (body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15))
                self.order.append(one)
            if not self.order or len(self.order) != len(self.components):
                raise ValueError("a scan that leaves components out")


def _coefficients(bits: _Bits, one: _Component, last: int, out: np.ndarray) -> int:
    """Reads one block into `out` (64 numbers in scan order); its DC value."""
    out[0] = last = last + bits.number(bits.symbol(one.dc))
    k = 1
    while k < 64:
        code = bits.symbol(one.ac)
        run, size = code >> 4, code & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a corrupt scan")
        out[k] = bits.number(size)
        k += 1
    return last


def luminance(data: bytes) -> np.ndarray:
    """(high, wide) 8-bit samples of the image's first component, brought to full size."""
    image = _Image(data)
    if len(image.order) == 1:  # blocks of a lone component follow each other whatever its factors
        image.order[0].across = image.order[0].down = 1
    across, down = max(c.across for c in image.order), max(c.down for c in image.order)
    units_wide, units_high = -(-image.wide // (8 * across)), -(-image.high // (8 * down))
    end = image.scan.rfind(b"\xff\xd9")
    scan = image.scan[: end if end >= 0 else len(image.scan)]
    # Stuffed bytes (ff 00) stay together; restart markers part the scan.
    stretches = [part.replace(b"\xff\x00", b"\xff") for part in re.split(rb"\xff[\xd0-\xd7]", scan)]
    first = image.order[0]
    if first.quantiser not in image.quantisers:
        raise ValueError("a quantiser is missing")
    held = np.zeros((units_high * first.down, units_wide * first.across, 64))
    other, units = np.zeros(64), units_wide * units_high
    step = image.restart or units
    for k, a in enumerate(range(0, units, step)):
        if k >= len(stretches):
            raise ValueError("a truncated scan")
        bits, last = _Bits(stretches[k]), [0] * len(image.order)
        for unit in range(a, min(a + step, units)):
            y, x = divmod(unit, units_wide)
            for c, one in enumerate(image.order):
                for i in range(one.down):
                    for j in range(one.across):
                        out = held[y * one.down + i, x * one.across + j] if c == 0 else other
                        last[c] = _coefficients(bits, one, last[c], out)
    blocks = np.zeros_like(held)
    blocks[..., ZIGZAG] = held * image.quantisers[first.quantiser]
    pixels = COSINES.T @ blocks.reshape(*blocks.shape[:2], 8, 8) @ COSINES + 128
    flat = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).swapaxes(1, 2).reshape(8 * held.shape[0], 8 * held.shape[1])
    return flat.repeat(down // first.down, axis=0).repeat(across // first.across, axis=1)[: image.high, : image.wide]


def block_means(pixels: np.ndarray) -> np.ndarray:
    """Mean of each 8 x 8 block, row by row; blocks at the edge may be smaller."""
    high, wide = pixels.shape
    rows, cols = np.arange(0, high, 8), np.arange(0, wide, 8)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, axis=0), cols, axis=1)
    return np.rint(sums / np.outer(np.diff(np.append(rows, high)), np.diff(np.append(cols, wide)))).astype(np.uint8).ravel()
