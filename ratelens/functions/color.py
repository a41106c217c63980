"""Per-image kernels on arrays: YCbCr both ways, channel errors and structural similarity."""

from __future__ import annotations

from functools import cache

import numpy as np



def psnr(mse: float) -> float:
    return float("inf") if mse == 0 else 10 * np.log10(65025 / mse)


def channel_errors(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Mean squared errors of two (h, w, 3) 8-bit images: R, G, B together, then Y, Cb, Cr and both
    chroma planes, in 16-bit fixed point."""
    ya, yb = ycbcr(a).astype(float), ycbcr(b).astype(float)
    d = ((ya - yb) ** 2).reshape(-1, 3).mean(axis=0)
    rgb = ((a.astype(float) - b.astype(float)) ** 2).mean()
    return {"mse_rgb": float(rgb), "mse_y": d[0], "mse_cb": d[1], "mse_cr": d[2], "mse_chroma": (d[1] + d[2]) / 2}


@cache
def _weights() -> tuple[np.ndarray, np.ndarray]:
    from ratelens.operators.blocks import WEIGHTS

    k = np.array([[int(abs(x) * 65536 + 0.5) * (1 if x >= 0 else -1) for x in row] for row in WEIGHTS], np.int64)
    return k, np.array([32768, 32768 + (128 << 16), 32768 + (128 << 16)], np.int64)


def ycbcr(rgb: np.ndarray) -> np.ndarray:
    k, offset = _weights()
    return np.clip((rgb.astype(np.int64) @ k.T + offset) >> 16, 0, 255).astype(np.uint8)


def rgb(ycc: np.ndarray) -> np.ndarray:
    """Inverse in 32-bit floats, rounded and clamped."""
    f = ycc.astype(np.float32)
    y, cb, cr = f[..., 0], f[..., 1] - np.float32(128), f[..., 2] - np.float32(128)
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.floor(out + np.float32(0.5)), 0, 255).astype(np.uint8)


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, radius: int = 5) -> float:
    """Mean structural similarity of two 8-bit planes: Gaussian window, population covariance,
    borders of the window's radius left out where the plane is large enough."""
    g = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, radius, mode="symmetric")
        p = sum(w * p[i : i + x.shape[0]] for i, w in enumerate(g))
        return sum(w * p[:, i : i + x.shape[1]] for i, w in enumerate(g))

    a, b = a.astype(float), b.astype(float)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    inner = s[radius:-radius, radius:-radius] if min(s.shape) > 2 * radius else s
    return float(inner.mean())
