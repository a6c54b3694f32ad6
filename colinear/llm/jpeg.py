"""Baseline JPEG in numpy: marker parsing, Huffman decoding of scans, DC-only luminance thumbnails.

All images of a batch that share their tables are decoded together: each restart interval is one lane, and every step
takes the next coefficient of all lanes. The encoder stores 8-bit samples losslessly as the DC coefficients of flat 8x8
blocks (quantiser 8, so that a block's value is exactly its sample), with a restart interval of 24 blocks.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# The standard luminance DC table (number of codes of each length, then the symbols).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
# The stored images have no AC coefficient: one code, of one bit, ends the block.
AC_LENGTHS = (1, *[0] * 15)
AC_SYMBOLS = (0,)

ROW = 24  # blocks in a restart interval
MAX_SIDE = 8191  # blocks in a side of 65,535 pixels
UNIT = 576


class JpegError(ValueError):
    """The stream is no baseline JPEG that can be decoded."""


def codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical order."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix: the symbol and its code's length (0: no such code)."""
    symbol, size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for s, (code, bits) in codes(lengths, symbols).items():
        symbol[code << 16 - bits : (code + 1) << 16 - bits] = s
        size[code << 16 - bits : (code + 1) << 16 - bits] = bits
    return symbol, size


@lru_cache(16)
def block_lookup(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix that holds a DC coefficient and the end of its block: the difference and the bits used.

    0 bits: the prefix holds no such block; it must be decoded step by step.
    """
    prefix = np.arange(1 << 16, dtype=np.int64)
    (symbol, size), (end, end_size) = lookup(*dc), lookup(*ac)
    used = size + symbol
    fits = (size > 0) & (used < 16)
    value = prefix >> np.where(fits, 16 - used, 0) & (1 << symbol) - 1
    rest = prefix << np.where(fits, used, 0) & 0xFFFF
    fits &= (end_size[rest] > 0) & (end[rest] == 0) & (used + end_size[rest] <= 16)
    diff = np.where(value < (1 << symbol >> 1), value - (1 << symbol) + 1, value)
    return np.where(fits, diff, 0).astype(np.int32), np.where(fits, used + end_size[rest], 0)


# ---------------------------------------------------------------- encoder


def _words() -> tuple[np.ndarray, np.ndarray]:
    """Code word and length of a block for each difference -255..255: DC code, value bits, end of block."""
    dc, word, size = codes(DC_LENGTHS, DC_SYMBOLS), np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, bits = dc[n]
        word[d + 255] = (code << n | (d if d >= 0 else d + (1 << n) - 1)) << 1
        size[d + 255] = bits + n + 1
    return word, size


WORD, SIZE = _words()


def frames(n_bytes: int) -> list[tuple[int, int]]:
    """Width and height, in blocks, of the images that hold a payload of n_bytes (a multiple of 576)."""
    rows, out = n_bytes // UNIT, []
    if rows * ROW <= MAX_SIDE:
        return [(ROW, rows * ROW)]
    while rows:
        out.append((UNIT, min(rows, MAX_SIDE)))
        rows -= out[-1][1]
    return out


def _head(width: int, height: int) -> bytes:
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xDB, b"\0" + b"\x08" + b"\x01" * 63)
        + part(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\x01\x11\0")
        + part(0xC4, b"\0" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS))
        + part(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
        + part(0xDD, struct.pack(">H", ROW))
        + part(0xDA, b"\x01\x01\0\0\x3f\0")
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 576 bytes) as one JPEG stream, or several laid end to end."""
    lanes = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    step = np.diff(lanes.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    word, size = WORD[step], SIZE[step]
    bits = size.sum(axis=1)
    pad = -bits % 8
    lane_bytes = (bits + pad) // 8
    starts = np.concatenate([[0], np.cumsum(lane_bytes)])
    # Four code words (60 bits at most) make one; each then adds its bits to three 32-bit cells of the stream.
    word, size = word.reshape(-1, 4), size.reshape(-1, 4)
    joined, long = word[:, 0].astype(np.uint64), size.sum(axis=1)
    for k in range(1, 4):
        joined = joined << size[:, k].astype(np.uint64) | word[:, k].astype(np.uint64)
    per = ROW // 4
    joined = np.column_stack([joined.reshape(-1, per), ((1 << pad) - 1).astype(np.uint64)])
    long = np.column_stack([long.reshape(-1, per), pad])
    at = (np.cumsum(long, axis=1) - long + starts[:-1, None] * 8).ravel()
    joined, long = joined.ravel(), long.ravel()
    joined <<= np.where(long > 0, 64 - long, 0).astype(np.uint64)
    cell, off = at >> 5, (at & 31).astype(np.uint64)
    total, low = int(starts[-1]), np.uint64(0xFFFFFFFF)
    parts = (joined >> (off + np.uint64(32)), joined >> off & low, joined << (np.uint64(32) - off) & low)
    cells = total // 4 + 4
    body = sum(np.bincount(cell + k, weights=x, minlength=cells) for k, x in enumerate(parts))
    body = np.frombuffer(body.astype(np.uint64).astype(">u4").tobytes(), np.uint8)[:total]
    full = body == 255
    shift = np.cumsum(full) - full  # zero bytes stuffed before each byte
    lane_of = np.repeat(np.arange(len(lanes)), lane_bytes)
    place = np.arange(total) + shift + 2 * lane_of
    out = np.zeros(total + int(full.sum()) + 2 * len(lanes), np.uint8)
    out[place] = body
    stuffed = np.concatenate([[0], np.cumsum(full)])[starts[1:]]
    ends = starts[1:] + stuffed + 2 * np.arange(len(lanes))  # place of the marker after each lane
    # Lanes of each image are numbered from 0; its last one is followed by EOI.
    shapes = [s for p in payloads for s in frames(len(p))]
    n = np.array([w * h // ROW for w, h in shapes])
    first = np.cumsum(n) - n
    number = np.arange(len(lanes)) - np.repeat(first, n)
    out[ends] = 255
    out[ends + 1] = 0xD0 + number % 8
    out[ends[first + n - 1] + 1] = 0xD9
    cut = np.concatenate([[0], ends[first + n - 1] + 2])
    raw, image, result = out.tobytes(), 0, []
    for p in payloads:
        parts = []
        for w, h in frames(len(p)):
            parts += [_head(w, h), raw[cut[image] : cut[image + 1]]]
            image += 1
        result.append(b"".join(parts))
    return result


# ---------------------------------------------------------------- decoder


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant_dc: dict[int, int] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    interval: int = 0
    start: int = 0  # of the entropy-coded data

    def layout(self) -> list[tuple[int, int]]:
        """(scan position, block number) of the blocks of an MCU."""
        if len(self.scan) == 1:
            return [(0, 0)]
        return [(i, b) for i, (c, _, _) in enumerate(self.scan) for b in range(self.components[c][1] * self.components[c][2])]

    def mcus(self) -> tuple[int, int]:
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        if len(self.scan) == 1:
            c = self.components[self.scan[0][0]]
            return -(-self.width * c[1] // (8 * h)), -(-self.height * c[2] // (8 * v))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def key(self) -> tuple:
        return tuple(self.layout()), tuple((self.tables[d], self.tables[16 + a]) for _, d, a in self.scan)


def parse(data: bytes, at: int = 0) -> Image:
    """The markers of one image up to its entropy-coded data."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no SOI marker")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise JpegError("no marker where one is due")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide, table = body[0] >> 4, body[0] & 15
                image.quant_dc[table] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                image.tables[body[0]] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            bits, image.height, image.width, k = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not image.height or not image.width:
                raise JpegError("not 8 bits, or no size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            image.start = at
            return image
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise JpegError("not baseline")


def decode(streams: list[bytes]) -> list[list[np.ndarray]]:
    """For each stream, the DC-only luminance thumbnail of each of its images (one sample for each 8x8 block)."""
    data = b"".join(streams)
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
    groups: dict[tuple, list[tuple[int, int, Image, int]]] = defaultdict(list)
    offset = 0
    for i, s in enumerate(streams):
        at, number, stop = offset, 0, offset + len(s)
        while at < stop:
            image = parse(data, at)
            end = int(ends[np.searchsorted(ends, image.start)])
            groups[image.key()].append((i, number, image, end))
            at, number = end + 2, number + 1
        offset = stop
    out: list[dict[int, np.ndarray]] = [{} for _ in streams]
    for images in groups.values():
        for (i, number, _, _), thumb in zip(images, _decode_group(raw, [(x[2], x[3]) for x in images]), strict=True):
            out[i][number] = thumb
    return [[x[k] for k in sorted(x)] for x in out]


def _decode_group(raw: np.ndarray, images: list[tuple[Image, int]]) -> list[np.ndarray]:
    lengths = np.array([end - x.start for x, end in images])
    body = np.concatenate([raw[x.start : end] for x, end in images])
    begin = np.cumsum(lengths) - lengths
    ff = np.flatnonzero(body == 255)
    after = body[np.minimum(ff + 1, len(body) - 1)]
    rst = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(body), bool)
    keep[ff[after == 0] + 1] = False
    keep[rst] = keep[rst + 1] = False
    lane_start = np.sort(np.concatenate([begin, rst + 2]))
    moved = np.cumsum(keep) - keep
    pos = moved[np.minimum(lane_start, len(body) - 1)].astype(np.int64) * 8
    packed = np.concatenate([body[keep], np.full(4, 255, np.uint8)]).astype(np.int32)
    window = packed[:-2] << 16 | packed[1:-1] << 8 | packed[2:]
    lanes_of = np.searchsorted(lane_start, begin)
    layout, tables = images[0][0].layout(), images[0][0].scan
    own = images[0][0]
    dc, ac = ([lookup(*own.tables[base + t[k]]) for t in tables] for base, k in ((0, 1), (16, 2)))
    fast = [block_lookup(own.tables[t[1]], own.tables[16 + t[2]]) for t in tables]
    blocks = np.zeros(len(pos), np.int64)
    n_mcu = [int(np.prod(x.mcus())) for x, _ in images]
    for (x, _), first, n, last in zip(images, lanes_of, n_mcu, [*lanes_of[1:], len(pos)], strict=True):
        each = x.interval or n
        if -(-n // each) != last - first:
            raise JpegError("restart markers are missing")
        blocks[first:last] = each
        blocks[last - 1] = n - each * (last - first - 1)
    luma = [i for i, (c, _, _) in enumerate(tables) if c == 0]
    if not luma:
        raise JpegError("no luminance in the scan")
    per = sum(i == luma[0] for i, _ in layout)
    values = np.zeros((len(pos), int(blocks.max()) * per), np.int32)
    last = np.zeros((len(tables), len(pos)), np.int32)

    def peek(p: np.ndarray) -> np.ndarray:
        try:
            return window[p >> 3] >> (8 - (p & 7)).astype(np.int32) & 0xFFFF
        except IndexError:
            raise JpegError("the scan ends too early") from None

    order = np.argsort(-blocks, kind="stable")
    ordered = -blocks[order]
    for t in range(int(blocks.max())):
        active = order[: np.searchsorted(ordered, -t, side="left")]
        whole = len(active) == len(pos)
        seen = 0
        for comp, _ in layout:
            p = pos if whole else pos[active]
            bits = peek(p)
            diff, used = fast[comp][0][bits], fast[comp][1][bits]
            if used.all():
                p = p + used
            else:
                symbol, size = dc[comp][0][bits], dc[comp][1][bits]
                if not size.all():
                    raise JpegError("no such code")
                p = p + size
                value = peek(p) >> (16 - symbol)
                diff = np.where(value < (1 << symbol >> 1), value - (1 << symbol) + 1, value)
                p = _skip_ac(p + symbol, peek, *ac[comp])
            if whole:
                last[comp] += diff
                now = last[comp]
            else:
                last[comp, active] += diff
                now = last[comp, active]
            if comp == luma[0]:
                if whole:
                    values[:, t * per + seen] = now
                else:
                    values[active, t * per + seen] = now
                seen += 1
            if whole:
                pos = p
            else:
                pos[active] = p
    out = []
    for (x, _), first, n, end in zip(images, lanes_of, n_mcu, [*lanes_of[1:], len(pos)], strict=True):
        dc_values = values[first:end, : (x.interval or n) * per].reshape(-1)[: n * per]
        quant = x.quant_dc[x.components[x.scan[luma[0]][0]][3]]
        samples = np.clip((dc_values * quant + 1024 + 4) >> 3, 0, 255).astype(np.uint8)
        wide, high = x.mcus()
        h, v = x.components[0][1:3] if per > 1 else (1, 1)
        grid = samples.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        top_h, top_v = (max(c[k] for c in x.components) for k in (1, 2))
        size = [-(-side * own // (8 * top)) for side, own, top in ((x.height, x.components[0][2], top_v), (x.width, x.components[0][1], top_h))]
        out.append(np.ascontiguousarray(grid[: size[0], : size[1]]))
    return out


def _skip_ac(p: np.ndarray, peek, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places after the AC coefficients of one block of each lane."""
    bits = peek(p)
    symbol, size = symbols[bits], sizes[bits]
    if not size.all():
        raise JpegError("no such code")
    p = p + size + (symbol & 15)
    at = np.flatnonzero(symbol)
    k = (symbol[at] >> 4) + 1
    while len(at):
        on = k < 63
        at, k = at[on], k[on]
        bits = peek(p[at])
        symbol, size = symbols[bits], sizes[bits]
        if not size.all():
            raise JpegError("no such code")
        p[at] += size + (symbol & 15)
        on = symbol != 0
        at, k = at[on], k[on] + (symbol[on] >> 4) + 1
    return p


def average_hash(thumb: np.ndarray, side: int = 8) -> str:
    """64-bit mean hash of a thumbnail: which of side x side cells lie above the mean of all cells."""
    cells = thumb
    for axis in (0, 1):
        n = cells.shape[axis]
        if n % side:
            edge = np.minimum(np.arange(side) * n // side, n - 1)
            wide = np.maximum(np.diff(np.append(edge, n)), 1)
            cells = np.add.reduceat(cells, edge, axis=axis, dtype=np.int64) // (wide[:, None] if axis == 0 else wide)
        else:
            shape = (side, n // side, cells.shape[1]) if axis == 0 else (cells.shape[0], side, n // side)
            cells = cells.reshape(shape).sum(axis=axis + 1, dtype=np.int64) // (n // side)
    return np.packbits(cells * cells.size > cells.sum()).tobytes().hex()
