"""Baseline JPEGs of another make: AC coefficients, subsampled colour, restart intervals, tables of their own."""

import random
import struct

import numpy as np
import pytest

pytest.importorskip("colinear.llm.queries")
from colinear.llm import jpeg  # noqa: E402

AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]


def huffman(symbols, bits):
    lengths = [0] * 16
    lengths[bits - 1] = len(symbols)
    return bytes(lengths) + bytes(symbols), {s: format(i, f"0{bits}b") for i, s in enumerate(symbols)}


def magnitude(v):
    size = abs(v).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def encoded(blocks, dc, ac, before):
    """Bits of one block of 64 coefficients, the DC one as the difference from ``before``."""
    size, bits = magnitude(blocks[0] - before)
    out, run = dc[size] + bits, 0
    last = max((k for k in range(1, 64) if blocks[k]), default=0)
    for k in range(1, last + 1):
        if not blocks[k]:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size, bits = magnitude(blocks[k])
        out, run = out + ac[run << 4 | size] + bits, 0
    return out + (ac[0] if last < 63 else "")


def made(rng, width, height, sampling, interval, quant):
    """(stream, DC values of the luminance blocks) of an image with random coefficients."""
    dc_table, dc = huffman(list(range(12)), 4)
    ac_table, ac = huffman(AC_SYMBOLS, 8)
    wide, high = -(-width // (8 * sampling[0])), -(-height // (8 * sampling[1]))
    luma = np.zeros((high * sampling[1], wide * sampling[0]), int)
    scans, bits, before, n = [], "", [0, 0, 0], 0
    for y in range(high):
        for x in range(wide):
            if interval and n and n % interval == 0:
                scans.append(bits)
                bits, before = "", [0, 0, 0]
            n += 1
            for comp, (h, v) in enumerate((sampling, (1, 1), (1, 1))):
                for j in range(v):
                    for i in range(h):
                        block = [rng.randrange(-1024 // quant, 1023 // quant)] + [rng.randrange(-900, 900) if rng.random() < 0.2 else 0 for _ in range(63)]
                        if rng.random() < 0.2:
                            block[1:] = [0] * 63
                        if rng.random() < 0.2:
                            block[63] = 5
                        bits += encoded(block, dc, ac, before[comp])
                        before[comp] = block[0]
                        if comp == 0:
                            luma[y * v + j, x * h + i] = block[0]
    body = b""
    for k, part in enumerate([*scans, bits]):
        part += "1" * (-len(part) % 8)
        packed = int(part, 2).to_bytes(len(part) // 8, "big") if part else b""
        body += (b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + packed.replace(b"\xff", b"\xff\x00")
    segment = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    stream = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xFE, b"a note \xff in it")
    stream += segment(0xDB, b"\0" + bytes([quant] + [7] * 63)) + segment(0xDB, b"\1" + bytes([11] * 64))
    stream += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, sampling[0] << 4 | sampling[1], 0, 2, 0x11, 1, 3, 0x11, 1]))
    stream += segment(0xC4, b"\x00" + dc_table + b"\x10" + ac_table) + (segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    stream += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"
    want = np.clip((luma * quant + 1024 + 4) >> 3, 0, 255)[: -(-height // 8), : -(-width // 8)]
    return stream, want


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
def test_thumbnails_of_foreign_images(sampling):
    rng = random.Random(sum(sampling))
    images = [made(rng, rng.randrange(1, 90), rng.randrange(1, 90), sampling, interval, quant) for interval in (0, 1, 3) for quant in (1, 8, 16) for _ in range(3)]
    for (stream, want), got in zip(images, jpeg.decode([s for s, _ in images]), strict=True):
        assert len(got) == 1 and got[0].shape == want.shape and (got[0] == want).all()


def test_what_is_no_baseline_image():
    stream, _ = made(random.Random(1), 20, 20, (1, 1), 0, 8)
    for bad in (stream.replace(b"\xff\xc0", b"\xff\xc2"), stream[: len(stream) // 2] + b"\xff\xd9", b"\xff\xd8\xff\xd9"):
        with pytest.raises(Exception):  # noqa: B017
            jpeg.decode([bad])
