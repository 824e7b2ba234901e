"""Registration of one date on the other, on block means small enough for one task, and outlines of detections.

A pair is one group: the decimated image has at most 9 million pixels whatever the scene's size, and pairs are spread
over tasks. What can't be registered is reported as failed and never guessed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 9_000_000
MAX_SHIFT = 32.0
MIN_RHO = 0.8
STEPS = 100
EPSILON = 1e-6
IDENTITY = 0.02


def standardised(img: np.ndarray, ok: np.ndarray) -> np.ndarray | None:
    """Valid pixels to mean 0 and deviation 1, others 0; None where the image is flat."""
    if not ok.any():
        return None
    mean, std = img[ok].mean(), img[ok].std()
    return None if std < 1e-6 else np.where(ok, (img - mean) / std, 0.0)


def sampled(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values, and where all four neighbours are inside."""
    h, w = img.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    inside = (y0 >= 0) & (x0 >= 0) & (y0 < h - 1) & (x0 < w - 1)
    y0, x0 = np.clip(y0, 0, h - 2), np.clip(x0, 0, w - 2)
    fy, fx = y - y0, x - x0
    top = img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx
    low = img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx
    return top * (1 - fy) + low * fy, inside


def rigid(a: np.ndarray, b: np.ndarray, start: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[float, float, float, float]:
    """Angle, dx, dy that put b on a, and the correlation there: steps of Gauss and Newton on standardised images."""
    h, w = a.shape
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    gy, gx = np.gradient(b)
    p, rho = np.array(start), -1.0
    for _ in range(STEPS):
        c, s = np.cos(p[0]), np.sin(p[0])
        x = c * (xx - cx) - s * (yy - cy) + cx + p[1]
        y = s * (xx - cx) + c * (yy - cy) + cy + p[2]
        moved, inside = sampled(b, y, x)
        if inside.sum() < 16:
            return *p, -1.0
        t, i = a[inside] - a[inside].mean(), moved[inside] - moved[inside].mean()
        norm = np.sqrt((t * t).sum() * (i * i).sum())
        new = float((t * i).sum() / norm) if norm > 0 else -1.0
        if abs(new - rho) < EPSILON:
            return *p, new
        rho = new
        dx, dy = sampled(gx, y, x)[0][inside], sampled(gy, y, x)[0][inside]
        u, v = (xx - cx)[inside], (yy - cy)[inside]
        jac = np.stack([dx * (-s * u - c * v) + dy * (c * u - s * v), dx, dy], axis=1)
        gain = (t * i).sum() / max((i * i).sum(), 1e-12)
        p = p + np.linalg.lstsq(jac - jac.mean(axis=0), t / max(gain, 1e-6) - i, rcond=None)[0]
    return *p, rho


def coarse_to_fine(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float, float]:
    """From block means of 8 down to single pixels; each level starts where the last one ended."""
    p = (0.0, 0.0, 0.0)
    rho = -1.0
    for f in (8, 4, 2, 1):
        h, w = a.shape[0] // f * f, a.shape[1] // f * f
        if min(h, w) // f < 16 and f > 1:
            continue
        small = [m[:h, :w].reshape(h // f, f, w // f, f).mean(axis=(1, 3)) for m in (a, b)]
        t, x, y, rho = rigid(*small, (p[0], p[1] / f, p[2] / f))
        p = (t, x * f, y * f)
    return *p, rho


def decimation(height: int, width: int) -> int:
    """The factor, doubled until at most MAX_PIXELS are left."""
    factor = 1
    while (height // factor) * (width // factor) > MAX_PIXELS:
        factor *= 2
    return factor


def decimated(pairs: DataFrame, factor: int) -> DataFrame:
    """Block means of pixels (pair_id, r, c, a, b, valid); a block is valid if all of it is."""
    return pairs.groupBy("pair_id", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.bool_and("valid").alias("valid"))


def register(pairs: DataFrame, factor: int = 1, decimate: bool = True) -> DataFrame:
    """For pixels (pair_id, r, c, a, b, valid) of pairs, each pair's angle and shift of b against a in
    pixels, the correlation, the largest shift of a corner, and status: aligned, identity (under 0.02 pixels) or
    alignment_failed (flat, correlation under 0.8 or a corner over 32 pixels). factor: decimation, by block means in Spark, done before where `decimate` is off."""
    small = decimated(pairs, factor) if decimate else pairs

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.r.max()) + 1, int(pdf.c.max()) + 1
        if h * w > MAX_PIXELS:
            raise ValueError(f"{h} x {w} pixels after decimation; at most {MAX_PIXELS}")
        img = {k: np.zeros((h, w)) for k in "ab"}
        ok = np.zeros((h, w), dtype=bool)
        at = pdf.r.to_numpy(), pdf.c.to_numpy()
        ok[at] = pdf.valid.to_numpy() & pdf.a.notna().to_numpy() & pdf.b.notna().to_numpy()
        for k in "ab":
            img[k][at] = pdf[k].fillna(0).to_numpy()
        a, b = (standardised(img[k], ok) for k in "ab")
        angle, dx, dy, rho = coarse_to_fine(a, b) if a is not None and b is not None else (0.0, 0.0, 0.0, -1.0)
        dx, dy = dx * factor, dy * factor
        half = np.hypot(h, w) / 2 * factor
        corner = float(np.hypot(dx, dy) + abs(angle) * half)
        status = "alignment_failed" if rho < MIN_RHO or corner > MAX_SHIFT else "identity" if corner < IDENTITY else "aligned"
        return pd.DataFrame({"pair_id": [pdf.pair_id.iloc[0]], "angle": [angle], "dx": [dx], "dy": [dy], "rho": [rho], "max_shift": [corner], "status": [status]})

    return small.groupBy("pair_id").applyInPandas(work, "pair_id long, angle double, dx double, dy double, rho double, max_shift double, status string")


def ring(r: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """The outer boundary of a 4-connected set of pixels, corner by corner, with the set on the left hand (y downwards)."""
    own = set(zip(r.tolist(), c.tolist(), strict=True))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in own:
        for p, q, beyond in (((x, y), (x, y + 1), (y, x - 1)), ((x, y + 1), (x + 1, y + 1), (y + 1, x)), ((x + 1, y + 1), (x + 1, y), (y, x + 1)), ((x + 1, y), (x, y), (y - 1, x))):
            if beyond not in own:
                out.setdefault(p, []).append(q)
    y = min(r)
    first = (int(min(c[r == y])), int(y))
    path, at, came = [first], (first[0], first[1] + 1), (0, 1)
    out[first].remove(at)
    while at != first:
        path.append(at)
        ways = out[at]
        # At a corner that two pixels share, keep to the own side.
        turn = {(q[0] - at[0]) * came[1] - (q[1] - at[1]) * came[0]: q for q in ways}
        to = turn[min(turn)] if len(ways) > 1 else ways[0]
        ways.remove(to)
        came, at = (to[0] - at[0], to[1] - at[1]), to
    keep = [p for i, p in enumerate(path) if (p[0] - path[i - 1][0]) * (path[(i + 1) % len(path)][1] - p[1]) != (p[1] - path[i - 1][1]) * (path[(i + 1) % len(path)][0] - p[0])]
    return [*keep, keep[0]]


def simplified(path: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas and Peucker's, on an open or closed path; no recursion, so any length will do."""
    pts = np.asarray(path, dtype=float)
    keep = np.zeros(len(pts), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(pts) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, v = pts[j] - pts[i], pts[i + 1 : j] - pts[i]
        n = np.hypot(*d)
        far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n > 0 else np.hypot(v[:, 0], v[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [tuple(p) for p in pts[keep].tolist()]


def outlines(labels: DataFrame, tolerance: float = 0.5, most: int = 1000) -> DataFrame:
    """Each component's outer ring as [x, y] corners, holes left out; the tolerance doubles until at most
    `most` corners are left."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        path = ring(pdf.r.to_numpy(), pdf.c.to_numpy())
        t = tolerance
        while len(path) > most:
            path = simplified(path, t)
            t *= 2
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "ring": [[list(map(float, p)) for p in path]]})

    return labels.groupBy("label").applyInPandas(work, "label long, ring array<array<double>>")
