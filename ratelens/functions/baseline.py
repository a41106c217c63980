"""Baseline image coding (container version 1): block transform, quantisation, canonical Huffman
codes. Every plane's blocks are independent but for the DC difference, so a plane is transformed,
quantised and turned into bits as whole arrays; only reading a bit stream goes symbol by symbol."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

from ratelens.functions import color
from ratelens.functions.models import huffman_codes, huffman_lengths
from ratelens.operators.blocks import CHROMA, LUMA, scaled_table, zigzag

# Chroma layouts by code, with the steps across and down.
LAYOUTS = {0: ("4:4:4", 1, 1), 1: ("4:2:2", 2, 1), 2: ("4:2:0", 2, 2)}
HEAD = struct.Struct("<BIIBBBI")
HEAD_SIZE, TABLES = 5 + HEAD.size, 4
#: Pixels that a header may claim.
MOST_PIXELS = 1 << 28


@cache
def _basis() -> np.ndarray:
    u, x = np.mgrid[0:8, 0:8]
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


def dct(blocks: np.ndarray) -> np.ndarray:
    """(n, 8, 8) samples -> coefficients; inverse_dct turns them back."""
    return _basis() @ blocks @ _basis().T


def inverse_dct(coefficients: np.ndarray) -> np.ndarray:
    return _basis().T @ coefficients @ _basis()


def split_blocks(plane: np.ndarray) -> np.ndarray:
    """(n, 8, 8) blocks in row order; border samples repeat where the plane ends inside a block."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def join_blocks(blocks: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, columns = -(-height // 8), -(-width // 8)
    return blocks.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * columns)[:height, :width]


def quantise(plane: np.ndarray, table: list[int]) -> np.ndarray:
    """(n, 64) levels in zig-zag order, halves to even."""
    c = dct(split_blocks(plane).astype(float) - 128).reshape(-1, 64)
    return np.rint(c / np.array(table, float)).astype(np.int32)[:, zigzag()]


def dequantise(levels: np.ndarray, table: list[int], height: int, width: int) -> np.ndarray:
    c = np.zeros((len(levels), 64))
    c[:, zigzag()] = levels
    samples = inverse_dct((c * np.array(table, float)).reshape(-1, 8, 8)) + 128
    return join_blocks(np.floor(np.clip(samples, 0, 255) + 0.5).astype(np.uint8), height, width)


def shrink(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Rounded means of across x down samples; the border repeats."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % down), (0, -w % across)), mode="edge").astype(np.int32)
    p = p.reshape(p.shape[0] // down, down, p.shape[1] // across, across).sum(axis=(1, 3))
    n = across * down
    return ((p + n // 2) // n).astype(np.uint8)


def _stretch(x: np.ndarray, axis: int, size: int) -> np.ndarray:
    """Twice as many samples, 3:1 between neighbours and four times as large, cut to size."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate((x[:1], x[:-1])), np.concatenate((x[1:], x[-1:]))
    out = np.stack((3 * x + before, 3 * x + after), axis=1).reshape(-1, *x.shape[1:])
    return np.moveaxis(out[:size], 0, axis)


def grow(plane: np.ndarray, across: int, down: int, height: int, width: int) -> np.ndarray:
    """Samples of the full size, 9:3:3:1 between the four nearest, in floats."""
    x, scale = plane.astype(np.int64), 1
    if down == 2:
        x, scale = _stretch(x, 0, height), scale * 4
    if across == 2:
        x, scale = _stretch(x, 1, width), scale * 4
    return (x[:height, :width] / scale).astype(np.float32)


def category(v: np.ndarray) -> np.ndarray:
    """Bits that a magnitude needs."""
    return np.frexp(np.abs(v).astype(float))[1]


def symbols(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a plane's (n, 64) levels all symbols in stream order: whether of DC, symbol, extra bits, how
    many. DC is the difference to the block before; zero runs of 16 and ends of block are symbols."""
    n = len(levels)
    dc = np.diff(levels[:, 0], prepend=0)
    block, at = np.nonzero(levels[:, 1:])
    at = at + 1
    first = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
    run = at - np.where(first, 0, np.concatenate(([0], at[:-1]))[: len(at)]) - 1
    v = levels[block, at]
    long = run // 16
    runs = np.repeat(np.arange(len(at)), long)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, block, at)
    end = np.flatnonzero(last < 63)
    none = np.zeros(len(runs), np.int64)
    parts = [  # (place: block, position, order there), of DC, symbol, value
        (np.arange(n) * 256, True, category(dc), dc), (block[runs] * 256 + at[runs] * 2, False, none + 0xF0, none),
        (block * 256 + at * 2 + 1, False, (run % 16) << 4 | category(v), v), (end * 256 + 255, False, end * 0, end * 0),
    ]
    order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
    of_dc = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])[order]
    symbol = np.concatenate([p[2] for p in parts])[order].astype(np.int64)
    value = np.concatenate([p[3] for p in parts])[order].astype(np.int64)
    size = np.where(of_dc, symbol, symbol & 15)
    size[~of_dc & (symbol == 0xF0)] = 0
    return of_dc, symbol, np.where(value < 0, value + (1 << size) - 1, value), size


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of given sizes, high bits first, the last byte filled with zeros."""
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = ends[row] - 1 - np.arange(len(row))
    return np.packbits((values[row] >> place & 1).astype(np.uint8)).tobytes()


def tables_bytes(specs: list[tuple[list[int], list[int]]]) -> bytes:
    """Each table as 16 counts of codes by length and its symbols."""
    if not all(valid_table(*s) for s in specs):
        raise ValueError("invalid code table")
    return b"".join(bytes(bits) + bytes(values) for bits, values in specs)


def read_tables(data: bytes, at: int = 0) -> tuple[list[tuple[list[int], list[int]]], int]:
    """The four tables and where they end."""
    out = []
    for _ in range(TABLES):
        bits = list(data[at : at + 16])
        values = list(data[at + 16 : at + 16 + sum(bits)])
        if len(bits) < 16 or len(values) < sum(bits) or not valid_table(bits, values):
            raise ValueError("invalid code table")
        out.append((bits, values))
        at += 16 + len(values)
    return out, at


def valid_table(bits: list[int], values: list[int]) -> bool:
    """Whether counts by length 1 to 16 make a prefix code of different symbols."""
    if len(bits) != 16 or not 0 < len(values) <= 256 or sum(bits) != len(values) or len(set(values)) != len(values):
        return False
    code = 0
    for length, n in enumerate(bits, 1):
        if not 0 <= n <= 255 or code + n > 1 << length:
            return False
        code = (code + n) << 1
    return True


def _planes(rgb: np.ndarray, layout: int) -> list[np.ndarray]:
    ycc = color.ycbcr(rgb)
    _, across, down = LAYOUTS[layout]
    return [ycc[..., 0], shrink(ycc[..., 1], across, down), shrink(ycc[..., 2], across, down)]


def encode(width: int, height: int, pixels: bytes, quality: int, layout: int, magic: bytes) -> bytes:
    """A version 1 container of interleaved 8-bit RGB, with code tables made for it."""
    if len(pixels) != 3 * width * height or not 1 <= quality <= 100 or layout not in LAYOUTS or len(magic) != 5:
        raise ValueError("pixels, quality, layout or magic don't fit")
    planes = _planes(np.frombuffer(pixels, np.uint8).reshape(height, width, 3), layout)
    found = [symbols(quantise(p, scaled_table(quality, LUMA if i == 0 else CHROMA))) for i, p in enumerate(planes)]
    specs, values, sizes = [], [], []
    for group in (found[:1], found[1:]):
        for of in (True, False):  # DC, AC; luma, then both chroma planes
            count = sum(np.bincount(s[d == of], minlength=256) for d, s, _, _ in group)
            specs.append(huffman_lengths({int(i): int(count[i]) for i in np.flatnonzero(count)}))
    for i, (of_dc, symbol, extra, size) in enumerate(found):
        code, length = np.zeros((2, 256), np.int64), np.zeros((2, 256), np.int64)
        for j, spec in enumerate(specs[0:2] if i == 0 else specs[2:4]):
            for s, (c, n) in huffman_codes(*spec).items():
                code[j, s], length[j, s] = c, n
        j = np.where(of_dc, 0, 1)
        values.append(code[j, symbol] << size | extra)
        sizes.append(length[j, symbol] + size)
    data = pack_bits(np.concatenate(values), np.concatenate(sizes))
    return magic + HEAD.pack(1, width, height, quality, layout, 1, len(data)) + tables_bytes(specs) + data


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            self.value = (self.value & ((1 << self.have) - 1)) << 64 | int.from_bytes(chunk.ljust(8, b"\0"), "big")
            self.have += 64
        return self.value >> (self.have - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.have -= n

    def read(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.have -= n
        return v

    @property
    def used(self) -> int:
        return self.at * 8 - self.have


def _lookup(spec: tuple[list[int], list[int]]) -> list[tuple[int, int] | None]:
    """For each 16 bits the symbol that they begin with and its length."""
    out: list = [None] * 65536
    for s, (code, n) in huffman_codes(*spec).items():
        first = code << (16 - n)
        out[first : first + (1 << (16 - n))] = [(s, n)] * (1 << (16 - n))
    return out


def read_levels(bits: _Bits, blocks: int, dc: list, ac: list) -> np.ndarray:
    out = np.zeros((blocks, 64), np.int32)
    previous = 0

    def next_(table: list) -> int:
        found = table[bits.peek(16)]
        if found is None:
            raise ValueError("no such code")
        bits.skip(found[1])
        return found[0]

    def amount(size: int) -> int:
        v = bits.read(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for b in range(blocks):
        size = next_(dc)
        if size > 15:
            raise ValueError("no such category")
        previous += amount(size)
        out[b, 0] = previous
        at = 1
        while at < 64:
            s = next_(ac)
            if s == 0:
                break
            at += s >> 4
            if s == 0xF0:
                at += 1
                continue
            if at > 63 or not s & 15:
                raise ValueError("beyond the block")
            out[b, at] = amount(s & 15)
            at += 1
        if at > 64:
            raise ValueError("beyond the block")
        if bits.used > 8 * len(bits.data):
            raise ValueError("truncated")
    return out


def decode(data: bytes, magic: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels) of a version 1 container with tables; ValueError says what is wrong."""
    if data[:5] != magic:
        raise ValueError("not a container")
    if len(data) < HEAD_SIZE:
        raise ValueError("truncated")
    version, w, h, quality, layout, own, size = HEAD.unpack_from(data, 5)
    if version != 1 or not own:
        raise ValueError("unsupported")
    if not w or not h or w * h > MOST_PIXELS or not 1 <= quality <= 100 or layout not in LAYOUTS:
        raise ValueError("invalid header")
    specs, at = read_tables(data, HEAD_SIZE)
    if len(data) != at + size:
        raise ValueError("length")
    _, across, down = LAYOUTS[layout]
    shapes = [(h, w)] + [(-(-h // down), -(-w // across))] * 2
    if sum(-(-a // 8) * -(-b // 8) for a, b in shapes) > 4 * size + 64:  # a block takes two bits at least
        raise ValueError("truncated")
    bits, lookups, planes = _Bits(data[at:]), [_lookup(s) for s in specs], []
    for i, (a, b) in enumerate(shapes):
        dc, ac = lookups[:2] if i == 0 else lookups[2:]
        levels = read_levels(bits, -(-a // 8) * -(-b // 8), dc, ac)
        planes.append(dequantise(levels, scaled_table(quality, LUMA if i == 0 else CHROMA), a, b))
    ycc = np.stack([planes[0].astype(np.float32), *(grow(p, across, down, h, w) for p in planes[1:])], axis=-1)
    return w, h, color.rgb(ycc).tobytes()
