"""The baseline JPEG decoder against images coded here, and clips of foreign videos."""

import random
import struct

import numpy as np
import pytest

from strataloom.llm import jpeg, media


def codes_of(counts, symbols):
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = f"{code:0{bits}b}"
            code, k = code + 1, k + 1
        code <<= 1
    return out


def coded(value):
    size = abs(value).bit_length()
    return size, f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""


def block_bits(coefficients, last, dc, ac):
    size, extra = coded(coefficients[0] - last)
    out, run = dc[size] + extra, 0
    for k in range(1, 64):
        if not coefficients[k]:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size, extra = coded(coefficients[k])
        out, run = out + ac[run << 4 | size] + extra, 0
    return out + (ac[0] if run else "")


def segment(marker, body):
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def image(seed, wide, high, factors, tables, restart=0):
    """(JPEG bytes, luminance by the definition of the transform)."""
    draw = random.Random(seed)
    across, down = max(f[0] for f in factors), max(f[1] for f in factors)
    if len(factors) == 1:
        across = down = 1
        factors = [(1, 1)]
    units = (-(-wide // (8 * across)), -(-high // (8 * down)))
    quantiser = [draw.randint(1, 12) for _ in range(64)]
    dc, ac = codes_of(*tables[0]), codes_of(*tables[0x10])
    held = np.zeros((units[1] * factors[0][1], units[0] * factors[0][0], 64))
    stretches, bits, last = [], "", [0] * len(factors)
    for u in range(units[0] * units[1]):
        if restart and u and u % restart == 0:
            stretches, bits, last = [*stretches, bits], "", [0] * len(factors)
        y, x = divmod(u, units[0])
        for c, (a, d) in enumerate(factors):
            for i in range(d):
                for j in range(a):
                    block = [draw.randint(-60, 60)] + [draw.randint(-9, 9) if draw.random() < 0.1 else 0 for _ in range(63)]
                    bits += block_bits(block, last[c], dc, ac)
                    last[c] = block[0]
                    if c == 0:
                        held[y * d + i, x * a + j] = block
    scan = b""
    for k, one in enumerate([*stretches, bits]):
        one += "1" * (-len(one) % 8)
        scan += int(one, 2).to_bytes(len(one) // 8, "big").replace(b"\xff", b"\xff\x00")
        scan += bytes([255, 0xD0 + k % 8]) if k < len(stretches) else b""
    n = len(factors)
    head = b"\xff\xd8" + segment(0xE0, b"AVI1\0\0") + segment(0xDB, b"\0" + bytes(quantiser))
    if tables is not STANDARD:
        head += b"".join(segment(0xC4, bytes([k]) + bytes(tables[k][0]) + bytes(tables[k][1])) for k in (0, 0x10))
    head += segment(0xC0, struct.pack(">BHHB", 8, high, wide, n) + b"".join(bytes([k + 1, a << 4 | d, 0]) for k, (a, d) in enumerate(factors)))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0")
    pixels = np.zeros((8 * held.shape[0], 8 * held.shape[1]))
    order = jpeg.zigzag()
    for r in range(held.shape[0]):
        for c in range(held.shape[1]):
            f = np.zeros((8, 8))
            for k in range(64):
                f[divmod(order[k], 8)] = held[r, c, k] * quantiser[k]
            s = lambda k: np.sqrt(0.5) if k == 0 else 1.0
            for p in range(8):
                for q in range(8):
                    pixels[8 * r + p, 8 * c + q] = 128 + 0.25 * sum(
                        s(v) * s(h) * f[v, h] * np.cos((2 * p + 1) * v * np.pi / 16) * np.cos((2 * q + 1) * h * np.pi / 16)
                        for v, h in np.argwhere(f))
    return head + scan + b"\xff\xd9", np.clip(np.rint(pixels), 0, 255)[:high, :wide]


STANDARD = jpeg.standard_tables()
OWN = {0: ([0, 0, 0, 12] + [0] * 12, list(range(12))), 0x10: ([0] * 8 + [162] + [0] * 7, sorted(STANDARD[0x10][1]))}


def test_tables():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))
    for counts, symbols in STANDARD.values():
        assert sum(counts) == len(symbols) == len(set(symbols))
        assert sum(n / 2**k for k, n in enumerate(counts, 1)) < 1


@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2)], [(2, 2), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("tables,restart", [(STANDARD, 0), (OWN, 3)])
def test_baseline_images(factors, tables, restart):
    data, want = image(5, 43, 27, factors, tables, restart)
    got = jpeg.luminance(data).astype(int)
    assert got.shape == want.shape and np.abs(got - want).max() <= 1
    means = jpeg.block_means(got.astype(np.uint8)).reshape(4, 6)
    assert abs(int(means[3, 5]) - got[24:, 40:].mean()) <= 0.5


def test_corrupt_images_raise():
    data, _ = image(1, 16, 16, [(1, 1)], STANDARD)
    for broken in (b"", b"\xff\xd8", data[:40], data[: len(data) // 2] + b"\xff\xd9", data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.luminance(broken)


def avi_of(frames, wide, high):
    parts, index, at = [], b"", 4
    for f in frames:
        parts.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1))
        index += b"00dc" + struct.pack("<III", 16, at, len(f))
        at += len(parts[-1])
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    avih = struct.pack("<14I", 40_000, 0, 0, 16, len(frames), 0, 1, 0, wide, high, 0, 0, 0, 0)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", avih)) + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_video_clips(spark):
    good, pixels = image(3, 32, 16, [(2, 1), (1, 1), (1, 1)], STANDARD)
    flat = media.store_text(b"some text " * 400)
    rows = [(1, avi_of([good, good, b"\xff\xd8 broken", good], 32, 16)), (2, flat), (3, b"not a video"), (4, None), (5, avi_of([], 8, 8)),
            (6, avi_of([b"junk"], 8, 8)), (6, b"RIFF\xff\xff\xff\x00AVI LIST")]
    got = {}
    for r in media.video_clips(spark.createDataFrame(rows, "id int, data binary"), "id", "data").collect():
        got.setdefault(r.id, []).append(r)
    first = got[1][0]
    assert (first.frames, first.bad_frames, first.width, first.end_s) == (4, 1, 32, 0.16) and abs(first.mean_grey - pixels.mean()) < 1
    assert sum(r.frames for r in got[2]) == 21 and got[2][0].bad_frames == 0 and got[2][0].error is None
    assert all(got[i][0].clip is None and got[i][0].error for i in (3, 4, 5)) and got[6][0].bad_frames == 1
    assert media.video_clips(spark.createDataFrame([], "id int, data binary"), "id", "data").count() == 0
