"""Pixel functions. Array columns (small images) stay in Catalyst; whole frames use NumPy kernels.

Kernels take 2-D uint8 gray arrays. They follow the usual textbook definitions; there is no image
library to compare them with here, so that tests check properties, not bit parity.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


# ---- array columns -----------------------------------------------------------------------

def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def pixel_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference over 255."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / (255.0 * F.size(a))


def global_ssim(a: Column, b: Column) -> Column:
    """One-window structural similarity from integer moments, within -1 and 1."""
    n = F.size(a).cast("double")
    ma, mb = _sum(a) / n, _sum(b) / n
    va, vb = _sum(F.transform(a, lambda x: x * x)) / n - ma * ma, _sum(F.transform(b, lambda x: x * x)) / n - mb * mb
    cov = _sum(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    low = (ma * ma + mb * mb + C1) * (va + vb + C2)
    return F.when(low == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * ma * mb + C1) * (2 * cov + C2) / low)))


def sign_hash(values: Column) -> Column:
    """64 sign bits of an array, the first value highest, as a signed long."""
    return F.aggregate(F.slice(values, 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("long")))


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- frames ------------------------------------------------------------------------------

#: Results that each remembered kernel keeps; beyond it begins anew.
KEPT = 8192


def remembered(f: Callable) -> Callable:
    """f, a pure function of pictures, with its last results by their content.

    Screens stand still and come again, in one source and in many; the names are digests, so that
    no picture is held.
    """
    kept: dict[tuple, object] = {}

    @functools.wraps(f)
    def run(*args):
        key = tuple((x.shape, x.dtype.str, hashlib.blake2b(np.ascontiguousarray(x), digest_size=16).digest()) if isinstance(x, np.ndarray) else x for x in args)
        if key not in kept:
            out = f(*args)
            if len(kept) >= KEPT:
                kept.clear()
            kept[key] = out
        return kept[key]

    return run


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area interpolation to h x w: each output pixel is the mean of the area it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        for i in range(m):
            a, b = i * n / m, (i + 1) * n / m
            k = np.arange(int(a), min(n, int(np.ceil(b))))
            out[i, k] = np.minimum(k + 1, b) - np.maximum(k, a)
        return out / out.sum(1, keepdims=True)

    return weights(img.shape[0], h) @ img.astype(float) @ weights(img.shape[1], w).T


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def resize_gray(rgb: np.ndarray, width: int) -> np.ndarray:
    """Gray, and smaller if it is wider than `width`; never larger."""
    g = gray(rgb) if rgb.ndim == 3 else rgb
    if g.shape[1] <= width:
        return g
    return np.clip(np.rint(resize(g, max(1, round(g.shape[0] * width / g.shape[1])), width)), 0, 255).astype(np.uint8)


def _same(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape != b.shape:
        raise ValueError(f"images differ in shape: {a.shape} and {b.shape}")


def frame_delta(a: np.ndarray, b: np.ndarray) -> float:
    _same(a, b)
    return float(np.abs(a.astype(np.int16) - b).mean() / 255)


@remembered
def frame_ssim(a: np.ndarray, b: np.ndarray) -> float:
    _same(a, b)
    x, y = a.astype(float), b.astype(float)
    mx, my = x.mean(), y.mean()
    low = (mx * mx + my * my + C1) * (x.var() + y.var() + C2)
    return 1.0 if low == 0 else float(np.clip((2 * mx * my + C1) * (2 * ((x - mx) * (y - my)).mean() + C2) / low, -1, 1))


@remembered
def block_change(a: np.ndarray, b: np.ndarray, grid: int = 8) -> float:
    """The largest block mean of absolute differences over 255, on a grid x grid layout."""
    _same(a, b)
    d = np.abs(a.astype(np.int16) - b).astype(float)
    ys, xs = (np.arange(grid + 1) * n // grid for n in a.shape)
    return max((float(d[y0:y1, x0:x1].mean()) for y0, y1 in zip(ys, ys[1:]) for x0, x1 in zip(xs, xs[1:]) if y1 > y0 and x1 > x0), default=0.0) / 255


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    d = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    d[0] /= np.sqrt(2)
    return d


DCT32 = _dct(32)


@remembered
def perceptual_hash(img: np.ndarray) -> int:
    """64 bits, row by row from the highest: low frequencies above the median of all but the mean."""
    low = (DCT32 @ resize(img, 32, 32) @ DCT32.T)[:8, :8].ravel()
    out = 0
    for bit in low > np.median(low[1:]):
        out = out << 1 | int(bit)
    return out


def shifted(img: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The image moved, with edge pixels repeated."""
    ys = np.clip(np.arange(img.shape[0]) + dy, 0, img.shape[0] - 1)
    xs = np.clip(np.arange(img.shape[1]) + dx, 0, img.shape[1] - 1)
    return img[np.ix_(ys, xs)]


def edges(img: np.ndarray, low: int = 80, high: int = 160) -> np.ndarray:
    """Canny edges: Sobel gradients, thinning across the gradient, hysteresis between two limits."""
    g = img.astype(np.int32)
    s = {(y, x): shifted(g, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)}
    gx = s[-1, 1] + 2 * s[0, 1] + s[1, 1] - s[-1, -1] - 2 * s[0, -1] - s[1, -1]
    gy = s[1, -1] + 2 * s[1, 0] + s[1, 1] - s[-1, -1] - 2 * s[-1, 0] - s[-1, 1]
    mag = np.abs(gx) + np.abs(gy)
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay * 2.414 < ax, ax * 2.414 < ay
    same = (gx ^ gy) >= 0
    top = np.zeros_like(mag, bool)
    for where, (dy, dx) in ((flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & same, (1, 1)), (~flat & ~steep & ~same, (1, -1))):
        top |= where & (mag > shifted(mag, -dy, -dx)) & (mag >= shifted(mag, dy, dx))
    weak, strong = top & (mag > low), top & (mag > high)
    while True:
        grown = strong.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown |= shifted(strong, dy, dx)
        grown &= weak
        grown |= strong
        if (grown == strong).all():
            return strong
        strong = grown


@remembered
def edge_density(img: np.ndarray) -> float:
    return float(edges(img).mean())


def edge_delta(a: np.ndarray, b: np.ndarray) -> float:
    _same(a, b)
    return float((edges(a) ^ edges(b)).mean())


@remembered
def sharpness(img: np.ndarray) -> float:
    g = img.astype(float)
    return float((shifted(g, 0, 1) + shifted(g, 0, -1) + shifted(g, 1, 0) + shifted(g, -1, 0) - 4 * g).var())


def score(pixel: float, edge: float, hamming: int, ssim: float) -> float:
    return 0.40 * pixel + 0.20 * edge + 0.20 * (hamming / 64) + 0.20 * max(0.0, 1 - ssim)


@remembered
def comparison(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """All differences of two frames; block_change is reported and not part of the score."""
    p, e, s = frame_delta(a, b), edge_delta(a, b), frame_ssim(a, b)
    h = (perceptual_hash(a) ^ perceptual_hash(b)).bit_count()
    return {"pixel_delta": p, "edge_delta": e, "phash_delta": h, "ssim": s, "block_change": block_change(a, b), "score": score(p, e, h, s)}


def crop(img: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The part between the given shares of width and height, rounded, at least one pixel."""
    h, w = img.shape[:2]
    a, c = (int(np.clip(round(v * w), 0, w - 1)) for v in (x0, x1))
    b, d = (int(np.clip(round(v * h), 0, h - 1)) for v in (y0, y1))
    c, d = max(a + 1, min(w, round(x1 * w))), max(b + 1, min(h, round(y1 * h)))
    return img[b:d, a:c]


def _long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """What is left of each row's runs of true cells that are at least `least` long (a 1-D opening)."""
    h, w = mask.shape
    pad = np.zeros((h, w + 2), np.int8)
    pad[:, 1:-1] = mask
    step = np.diff(pad, axis=1)
    row, start = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    edge = np.zeros((h, w + 1), np.int32)
    keep = stop - start >= least
    np.add.at(edge, (row[keep], start[keep]), 1)
    np.add.at(edge, (row[keep], stop[keep]), -1)
    return np.cumsum(edge, axis=1)[:, :-1] > 0


@remembered
def layout(img: np.ndarray) -> dict[str, float]:
    """The six features that routing reads, from the body of the frame."""
    body = crop(img, 0.02, 0.08, 0.98, 0.90)
    e = edges(body)
    line = max(3, round(24 * img.shape[1] / 480))
    return {
        "mean_luma": float(body.mean()), "dark_ratio": float((body < 64).mean()), "bright_ratio": float((body > 220).mean()), "edge_density": float(e.mean()),
        "horizontal_line_ratio": float(_long_runs(e, line).mean()), "vertical_line_ratio": float(_long_runs(e.T, line).mean()),
    }


def _coverage(mask: np.ndarray, size: int) -> tuple[float, float, float]:
    rows, cols = mask.mean(1) if mask.size else np.zeros(0), mask.mean(0) if mask.size else np.zeros(0)
    return float(mask.sum() / max(1, size)), float((rows >= 0.04).mean()) if len(rows) else 0.0, float((cols >= 0.02).mean()) if len(cols) else 0.0


@remembered
def table_geometry(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Where two worksheet frames differ: in narrow bands (a moved highlight) and in the rest."""
    _same(a, b)
    h = a.shape[0]
    lo, hi = round(0.25 * h), max(round(0.25 * h) + 1, round(0.92 * h))
    mask = np.abs(a[lo:hi].astype(np.int16) - b[lo:hi]) >= 12
    dense = np.flatnonzero(mask.mean(1) >= 0.60)
    lit = np.zeros(len(mask), bool)
    if len(dense):
        breaks = np.flatnonzero(np.diff(dense) > 3)
        for x, y in zip(np.append(0, breaks + 1), np.append(breaks, len(dense) - 1)):
            top, end = dense[x], dense[y] + 1
            if end - top <= 0.20 * len(mask):
                lit[max(0, top - 1) : end + 1] = True
    light, rest = mask & lit[:, None], mask & ~lit[:, None]
    ratio, rows, cols = _coverage(mask, mask.size)
    r_ratio, r_rows, r_cols = _coverage(rest, mask.size)
    return {
        "changed_ratio": ratio, "row_coverage": rows, "column_coverage": cols, "residual_ratio": r_ratio, "residual_row_coverage": r_rows, "residual_column_coverage": r_cols,
        "highlight_ratio": float(light.sum() / max(1, mask.size)), "highlight_row_share": float(lit.mean()), "highlight_column_coverage": float((light.any(0)).mean()),
    }


def components(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """(area, width, height) of the 8-connected components, by runs joined to the row above."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        step = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
        now = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            parent.append(len(parent))
            boxes.append([b - a, a, b, y, y + 1])
            i = len(parent) - 1
            for c, d, j in above:
                if c <= b and d >= a:
                    x, z = find(i), find(j)
                    if x != z:
                        parent[z] = x
                        p, q = boxes[x], boxes[z]
                        boxes[x] = [p[0] + q[0], min(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4])]
            now.append((a, b, i))
        above = now
    return [(n, x1 - x0, y1 - y0) for i, (n, x0, x1, y0, y1) in enumerate(boxes) if find(i) == i]


@remembered
def slide_geometry(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """How a slide changed: shares of changed pixels and blocks, edges lost and gained, and components."""
    _same(a, b)
    a, b = crop(a, 0.04, 0.02, 0.98, 0.90), crop(b, 0.04, 0.02, 0.98, 0.90)
    d = np.abs(a.astype(np.int16) - b)
    mask = d >= 12
    old, new = edges(a), edges(b)

    def near(e: np.ndarray) -> np.ndarray:
        return np.any([shifted(e, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)

    lost, gain = (old & ~near(new)).sum(), (new & ~near(old)).sum()
    ys, xs = (np.arange(9) * n // 8 for n in mask.shape)
    blocks = [mask[y0:y1, x0:x1].mean() >= 0.02 for y0, y1 in zip(ys, ys[1:]) for x0, x1 in zip(xs, xs[1:]) if y1 > y0 and x1 > x0]
    parts = components(mask)
    area, width, height = max(parts, default=(0, 0, 0))
    return {
        "changed_ratio": float(mask.mean()), "soft_changed_ratio": float((d >= 6).mean()), "edge_delta": float((old ^ new).mean()), "block_spread": float(np.mean(blocks)) if blocks else 0.0,
        "edge_loss": float(lost / old.size), "edge_gain": float(gain / old.size), "retained": 1.0 if not old.any() else float(1 - lost / old.sum()),
        "largest_area": area / mask.size, "largest_width": width / mask.shape[1], "largest_height": height / mask.shape[0], "component_count": len(parts),
    }
