"""Pixel metrics, restoration and embeddings in NumPy; images are height x width x 3 arrays of bytes in BGR order.

Values follow the usual definitions of these filters; a decoder or recogniser is the caller's. An image is decoded once for all of
its metrics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("lapvar", "tenengrad", "luma", "clip_low", "clip_high", "rms", "noise", "colorfulness", "textness")
METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def to_gray(img: np.ndarray) -> np.ndarray:
    b, g, r = (img[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def convolve(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation with a small kernel; the border mirrors without its edge."""
    k = kernel.shape[0] // 2
    p = np.pad(x.astype(np.float64), k, mode=mode)
    h, w = x.shape
    out = np.zeros((h, w))
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + h, j : j + w]
    return out


def sharpness_lapvar(gray: np.ndarray) -> float:
    return float(convolve(gray, np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])).var())


def sharpness_tenengrad(gray: np.ndarray) -> float:
    sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return float((convolve(gray, sobel) ** 2 + convolve(gray, sobel.T) ** 2).mean())


def noise_sigma(gray: np.ndarray) -> float:
    """The fast estimate from a difference of Laplacians, over the interior."""
    h, w = gray.shape
    if h < 3 or w < 3:
        return 0.0
    m = convolve(gray, np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]]))[1:-1, 1:-1]
    return float(np.sqrt(np.pi / 2) * np.abs(m).sum() / (6 * (w - 2) * (h - 2)))


def exposure(gray: np.ndarray) -> tuple[float, float, float, float]:
    """Mean, shares of near black and near white, and contrast."""
    return float(gray.mean() / 255), float((gray <= 8).mean()), float((gray >= 247).mean()), float(gray.std() / 255)


def colorfulness(img: np.ndarray) -> float:
    b, g, r = (img[..., i].astype(np.float64) for i in range(3))
    rg, yb = r - g, 0.5 * (r + g) - b
    return float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()))


def metrics(img: np.ndarray, textness: float = 0.0) -> dict[str, float]:
    gray = to_gray(img)
    luma, low, high, rms = exposure(gray)
    return {
        "lapvar": sharpness_lapvar(gray), "tenengrad": sharpness_tenengrad(gray), "luma": luma, "clip_low": low, "clip_high": high, "rms": rms,
        "noise": noise_sigma(gray), "colorfulness": colorfulness(img), "textness": min(max(textness, 0.0), 1.0),
    }


@F.pandas_udf(METRICS)
def frame_metrics(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Metrics of raw images of three bytes a pixel."""
    return pd.DataFrame([metrics(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for h, w, d in zip(height, width, data, strict=True)])


def white_balance(img: np.ndarray, p: int = 6, most: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Shades of gray: channels scaled to a common p-norm."""
    norms = np.maximum((img.reshape(-1, 3).astype(np.float64) ** p).mean(axis=0) ** (1 / p), 1e-6)
    gains = np.clip(norms.mean() / norms, 1 / most, most)
    return np.clip(np.rint(img * gains), 0, 255).astype(np.uint8), gains


def adaptive_gamma(img: np.ndarray, target: float = 0.48, low: float = 0.45, high: float = 2.2) -> tuple[np.ndarray, float]:
    mean = float(to_gray(img).mean() / 255)
    if mean <= 1e-4 or mean >= 1 - 1e-4:
        return img.copy(), 1.0
    g = float(np.clip(np.log(target) / np.log(mean), low, high))
    if abs(g - 1) < 0.02:
        return img.copy(), 1.0
    return ((np.arange(256) / 255.0) ** g * 255).astype(np.uint8)[img], g


def clahe(img: np.ndarray, clip_limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the luma in tiles, interpolated between their centres; chroma keeps its offsets."""
    gray = to_gray(img)
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            top = max(clip_limit * part.size / 256, 1.0)
            extra = np.maximum(hist - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, top) + extra / 256) * 255 / max(part.size, 1)
    fy, fx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], gray]
    made = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))
    return np.clip(np.rint(img + (made - gray)[..., None]), 0, 255).astype(np.uint8)


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(int(np.ceil(3 * sigma)), 1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    pad = np.pad(x.astype(np.float64), ((r, r), (r, r)), mode="reflect" if min(x.shape) > r else "edge")
    rows = sum(k[i] * pad[i : i + x.shape[0]] for i in range(2 * r + 1))
    return sum(k[i] * rows[:, i : i + x.shape[1]] for i in range(2 * r + 1))


def unsharp(img: np.ndarray, sigma: float = 1.2, amount: float = 0.6) -> np.ndarray:
    if amount <= 0:
        return img.copy()
    soft = np.stack([gaussian(img[..., c], sigma) for c in range(3)], axis=-1)
    return np.clip(np.rint((1 + amount) * img - amount * soft), 0, 255).astype(np.uint8)


def denoise(img: np.ndarray, strength: float) -> np.ndarray:
    """Non-local means over 3 x 3 patches in a 7 x 7 window."""
    src = img.astype(np.float64)
    total, weight = np.zeros_like(src), np.zeros(src.shape[:2])
    p = np.pad(src, ((3, 3), (3, 3), (0, 0)), mode="reflect")
    h, w = src.shape[:2]
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            other = p[3 + dy : 3 + dy + h, 3 + dx : 3 + dx + w]
            gap = convolve(((src - other) ** 2).mean(axis=2), np.full((3, 3), 1 / 9))
            k = np.exp(-gap / max(strength * strength, 1e-6))
            total += k[..., None] * other
            weight += k
    return np.clip(np.rint(total / weight[..., None]), 0, 255).astype(np.uint8)


def rescue(img: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Balance, gamma and local contrast of a dark image, and the stages that did something."""
    balanced, gains = white_balance(img)
    lit, g = adaptive_gamma(balanced)
    return clahe(lit), [*(["white_balance"] if np.abs(gains - 1).max() > 0.02 else []), *(["gamma"] if g != 1 else []), "clahe"]


def enhance(img: np.ndarray, reference: float, noise_above: float = 2.5) -> tuple[np.ndarray, list[str]]:
    """The full chain for a picked image: denoised if noisy before or after gamma, sharpened if soft for its stratum."""
    stages = []
    out, gains = white_balance(img)
    if np.abs(gains - 1).max() > 0.02:
        stages.append("white_balance")
    before = noise_sigma(to_gray(out))
    out, g = adaptive_gamma(out)
    if g != 1:
        stages.append("gamma")
    sigma = max(before, noise_sigma(to_gray(out)))
    if sigma > noise_above:
        out = denoise(out, float(np.clip(round(2.5 * sigma), 3, 12)))
        stages.append("denoise")
    out = clahe(out)
    stages.append("clahe")
    if sharpness_lapvar(to_gray(out)) < 0.6 * max(reference, 1e-6):
        out = unsharp(out)
        stages.append("sharpen")
    return out, stages


def area_resize(x: np.ndarray, n: int) -> np.ndarray:
    """Means of an n x n grid, with fractional borders."""

    def weights(size: int) -> np.ndarray:
        edges = np.linspace(0, size, n + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        at = np.arange(size)[None, :]
        return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) / (size / n)

    return weights(x.shape[0]) @ x.astype(np.float64) @ weights(x.shape[1]).T


def phash_bits(img: np.ndarray) -> np.ndarray:
    """Signs against the median of the 63 lowest cosine coefficients."""
    small = area_resize(to_gray(img), 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    basis *= np.where(k[:, None] == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    low = (basis @ small @ basis.T)[:8, :8].ravel()[1:]
    return np.where(low > np.median(low), 1.0, -1.0)


def hsv_histogram(img: np.ndarray) -> np.ndarray:
    """Shares of 8 x 8 x 4 bins of hue, saturation and value."""
    x = img.astype(np.float64) / 255
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    v = x.max(axis=-1)
    c = v - x.min(axis=-1)
    safe = np.where(c == 0, 1, c)
    hue = np.where(v == r, ((g - b) / safe) % 6, np.where(v == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    hue = np.where(c == 0, 0, hue)
    sat = np.where(v == 0, 0, c / np.where(v == 0, 1, v))
    place = np.minimum((hue * 8).astype(int), 7) * 32 + np.minimum((sat * 8).astype(int), 7) * 4 + np.minimum((v * 4).astype(int), 3)
    n = np.bincount(place.ravel(), minlength=256).astype(np.float64)
    return n / n.sum() if n.sum() else n


def embed(img: np.ndarray, weights: tuple[float, float] = (0.6, 0.4)) -> np.ndarray:
    """Hash bits and colour shares as one unit vector."""
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-8)
    a, b = (w / sum(weights) for w in weights)
    return unit(np.concatenate([unit(phash_bits(img)) * np.sqrt(a), unit(hsv_histogram(img)) * np.sqrt(b)]))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def frame_embedding(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([embed(np.frombuffer(d, np.uint8).reshape(h, w, 3)).astype(np.float32) for h, w, d in zip(height, width, data, strict=True)])


def union_area(boxes: list[tuple[int, int, int, int]]) -> int:
    """Area that boxes of x, y, width and height cover; overlaps count once."""
    xs = sorted({v for x, _, w, _ in boxes for v in (x, x + w)})
    total = 0
    for a, b in zip(xs, xs[1:], strict=False):
        end = None
        for y, top in sorted((y, y + h) for x, y, w, h in boxes if x <= a and x + w >= b):
            start = y if end is None else max(y, end)
            total += (b - a) * max(0, top - start)
            end = top if end is None else max(end, top)
    return total
