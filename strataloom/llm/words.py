"""Words of byte text as arrays: boundaries, hashes and hashes of word windows, without Python
strings."""

from __future__ import annotations

import numpy as np

from strataloom.llm.common import U64, Powers, byte_codes, mix64

_CODES = byte_codes(11)
_BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
_WORD_POWERS = Powers(0xC2B2AE3D27D4EB4F | 1)

#: Lower-casing of A-Z alone; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 0-9, a-z and every byte of a non-ASCII character.
WORDY = np.zeros(256, bool)
WORDY[0x30:0x3A] = WORDY[0x61:0x7B] = WORDY[0x80:] = True

#: All bytes but the blanks 0x20 and 0x09-0x0D.
UNBLANK = np.ones(256, bool)
UNBLANK[0x20] = UNBLANK[0x09:0x0E] = False


def word_bounds(low: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of member bytes within a row), and for each row the
    number of words before it (n + 1 numbers)."""
    inside = member[low]
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's first byte; the last entry is past the end
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, mixed."""
    with np.errstate(over="ignore"):
        up, down = _BYTE_POWERS.upto(len(low) + 1)
        sums = np.zeros(len(low) + 1, U64)
        np.cumsum(_CODES[low] * up[: len(low)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words; entry i is the run that starts at word i."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        up, down = _WORD_POWERS.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix64((sums[length:] - sums[:n]) * down[:n] + U64(length))
