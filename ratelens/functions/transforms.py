"""Integer kernels on arrays: 14-bit DCTs and opponent colours of cone responses."""

from __future__ import annotations

from functools import cache

import numpy as np

# Cone mixing in 12 bits, its inverse in 20 bits, then scales and neutral levels of
# the red-green and blue-yellow axes.
CONES = np.array([[1700, 2160, 236], [900, 2900, 296], [120, 500, 3476]], np.int64)
CONES_INVERSE = np.array([[4170622, -3103133, -18912], [-1298702, 2469386, -122107], [42830, -248077, 1253823]], np.int64)
SCALES, NEUTRAL = (59, 253), (94, 115)
TOP = 65535


@cache
def dct_matrix(size: int) -> np.ndarray:
    """Orthonormal DCT-II of `size` points, times 2**14, rounded."""
    u, x = np.arange(size)[:, None], np.arange(size)[None, :]
    m = np.sqrt(np.where(u == 0, 1, 2) / size) * np.cos((2 * x + 1) * u * np.pi / (2 * size))
    return np.rint(m * 16384).astype(np.int64)


def _halves_away(v: np.ndarray, d: int) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + d // 2) // d)


def dct(blocks: np.ndarray) -> np.ndarray:
    """(.., n, n) integers -> coefficients, halves rounded away from zero after both passes."""
    m = dct_matrix(blocks.shape[-1])
    return _halves_away(m @ blocks.astype(np.int64) @ m.T, 1 << 28)


def inverse_dct(blocks: np.ndarray) -> np.ndarray:
    m = dct_matrix(blocks.shape[-1])
    return _halves_away(m.T @ blocks.astype(np.int64) @ m, 1 << 28)


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """sRGB to linear, linear to cone response, and both inverses."""
    s = np.arange(256, dtype=np.int64)
    linear = (s * s * 257 + 127) // 255
    knots = np.minimum(np.arange((TOP >> 4) + 2, dtype=np.int64) << 4, TOP)
    root = np.floor(np.cbrt(knots.astype(float) * TOP * TOP)).astype(np.int64)
    for step in (-1, 1):  # floating point may be off by one
        root += step * np.where(step * (knots * TOP * TOP - np.maximum(root, root + step) ** 3) >= (0 if step > 0 else 1), 1, 0)
    root += knots * TOP * TOP - root**3 > (root + 1) ** 3 - knots * TOP * TOP
    v = np.arange(TOP + 1, dtype=np.int64)
    low, part = root[v >> 4], v & 15
    response = (low * (16 - part) + root[np.minimum((v >> 4) + 1, len(root) - 1)] * part + 8) >> 4
    response[TOP] = TOP
    nearest = lambda t: np.minimum(np.searchsorted(t[:-1] + t[1:], 2 * v), len(t) - 1)  # noqa: E731  ties to the lower
    return linear, response, nearest(response), nearest(linear)


def to_opponent(rgb: np.ndarray) -> np.ndarray:
    """(.., 3) 8-bit RGB -> intensity, red-green and blue-yellow, 8-bit."""
    linear, response, _, _ = _tables()
    r = response[(linear[rgb] @ CONES.T + 2048) >> 12]
    mean = (r[..., 0] + r[..., 1] + 1) // 2
    out = [(mean + 128) // 257, NEUTRAL[0] + _halves_away(r[..., 0] - r[..., 1], SCALES[0]), NEUTRAL[1] + _halves_away(r[..., 2] - mean, SCALES[1])]
    return np.clip(np.stack(out, axis=-1), 0, 255).astype(np.uint8)


def from_opponent(planes: np.ndarray) -> np.ndarray:
    """The inverse; the two axes may carry up to four fraction bits by being floats."""
    _, _, to_linear, to_srgb = _tables()
    p = planes.astype(float)
    mean = p[..., 0].astype(np.int64) * 257
    x, b = (_halves_away((np.rint(p[..., i + 1] * 16).astype(np.int64) - NEUTRAL[i] * 16) * SCALES[i], 16) for i in (0, 1))
    half = _halves_away(x, 2)
    cones = to_linear[np.clip(np.stack([mean + half, mean - half, mean + b], axis=-1), 0, TOP)]
    return to_srgb[np.clip(_halves_away(cones @ CONES_INVERSE.T, 1 << 20), 0, TOP)].astype(np.uint8)
