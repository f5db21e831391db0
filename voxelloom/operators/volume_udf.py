"""Operators that need a whole instance or a whole volume at once, in NumPy.

Distances, reconstruction and flooding are global orders over an object, so
they run as one call for each instance (its bounding box) or each volume, with
``applyInPandas``; memory is that of the largest instance or volume. Many
volumes spread over executors; one huge volume does not, and for it
``labels.rainfall`` is the distributed way.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AXES
from .stencil import gaussian_weights

_SCHEMA = "volume_id string, z int, y int, x int, value double"


def _lower_envelope(f: np.ndarray, step: float = 1.0) -> np.ndarray:
    """min over q of (p - q)^2 + f(q), for all p, along the last axis of a 2-D array (Felzenszwalb and Huttenlocher)."""
    n = f.shape[-1]
    out = np.empty_like(f)
    for row in range(f.shape[0]):
        g = f[row]
        on = np.flatnonzero(np.isfinite(g))
        if not len(on):
            out[row] = np.inf
            continue
        v, z = [int(on[0])], [-np.inf]
        for q in on[1:].tolist():
            while True:
                s = ((g[q] + q * q) - (g[v[-1]] + v[-1] * v[-1])) / (2 * q - 2 * v[-1])
                if s > z[-1]:
                    break
                v.pop()
                z.pop()
            v.append(q)
            z.append(s)
        at = np.searchsorted(np.array(z), np.arange(n), "left") - 1
        at = np.maximum(at, 0)
        q = np.array(v)[at]
        out[row] = (np.arange(n) - q) ** 2 + g[q]
    return out


def edt(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each cell to the nearest cell where the mask is false; infinite without any."""
    d = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        moved = np.moveaxis(d, axis, -1)
        d = np.moveaxis(_lower_envelope(moved.reshape(-1, moved.shape[-1])).reshape(moved.shape), -1, axis)
    return np.sqrt(d)


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter, edges mirrored with the edge repeated."""
    w = np.array(gaussian_weights(sigma))
    r = len(w) // 2
    for axis in range(a.ndim):
        if a.shape[axis] > 1:
            p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], "symmetric")
            a = sum(wk * np.take(p, np.arange(k, k + a.shape[axis]), axis) for k, wk in enumerate(w))
    return a


def instance_heat(mask: np.ndarray, low: float = -2.0, high: float = 20.0) -> np.ndarray:
    """Distances to the border of an instance scaled to [low, high]; NaN outside it.

    The mask is smoothed and thresholded twice first, unless that empties it.
    An instance of one layer along some axis is taken layer by layer in 2-D.
    Constant distances become high.
    """
    m = mask.astype(float)
    for _ in range(2):
        m = (smooth(m, 1.0) > 0.4).astype(float)
    body = m > 0 if m.any() else mask.astype(bool)
    where = np.argwhere(body)
    extent = where.max(0) - where.min(0)
    if (extent > 1).all():
        d = edt(np.pad(body, 1))[tuple(slice(1, -1) for _ in body.shape)]
    else:
        axis = int(np.argmin(extent)) if (extent == extent.min()).sum() == 1 else 0
        d = np.stack([edt(np.pad(s, 1))[1:-1, 1:-1] if s.any() else np.zeros(s.shape) for s in np.moveaxis(body, axis, 0)])
        d = np.moveaxis(d, 0, axis)
    inside = d[body]
    a, b = inside.min(), inside.max()
    out = np.full(mask.shape, np.nan)
    out[body] = high if a == b else low + (inside - a) / (b - a) * (high - low)
    return out


def heat_parts(labels: DataFrame, low: float = -2.0, high: float = 20.0) -> DataFrame:
    """(volume_id, label, z, y, x, heat) of each instance of more than three voxels, from its bounding box with a margin of one."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) <= 3:
            return frame.iloc[:0].assign(heat=0.0)
        at = frame[list(AXES)].to_numpy()
        origin = at.min(0) - 1
        mask = np.zeros(at.max(0) - origin + 2, bool)
        mask[tuple((at - origin).T)] = True
        heat = instance_heat(mask, low, high)
        where = np.argwhere(~np.isnan(heat))
        place = where + origin
        return pd.DataFrame({"volume_id": frame.volume_id.iloc[0], "label": frame.label.iloc[0], "z": place[:, 0], "y": place[:, 1], "x": place[:, 2], "heat": heat[tuple(where.T)]})

    return labels.filter("label <> 0").select("volume_id", "label", *AXES).groupBy("volume_id", "label").applyInPandas(one, "volume_id string, label int, z int, y int, x int, heat double")


def heatmap(labels: DataFrame, background: float = -5.0, low: float = -2.0, high: float = 20.0) -> DataFrame:
    """The heat of each voxel; where instances meet that of the larger label, background elsewhere."""
    best = heat_parts(labels, low, high).groupBy("volume_id", *AXES).agg(F.max_by("heat", "label").alias("heat"))
    return labels.join(best, ["volume_id", *AXES], "left").withColumn("heat", F.coalesce("heat", F.lit(background)))


def _dense(frame: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    at = frame[list(AXES)].to_numpy()
    origin = at.min(0)
    shape = at.max(0) - origin + 1
    out = []
    for c in columns:
        a = np.zeros(shape, frame[c].dtype)
        a[tuple((at - origin).T)] = frame[c].to_numpy()
        out.append(a)
    return at - origin, out


def distances(voxels: DataFrame) -> DataFrame:
    """Distance of each voxel with value > 0 to the nearest one without, volume by volume; 0 elsewhere, and where there is none (value infinite)."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        at, (v,) = _dense(frame, ["value"])
        return frame.assign(value=edt(v > 0)[tuple(at.T)])

    return voxels.select("volume_id", *AXES, "value").groupBy("volume_id").applyInPandas(one, _SCHEMA)


# ---- resampling


def _spline_coefficients(a: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the last axis, ends mirrored without repeating the edge (Unser)."""
    n, pole = a.shape[-1], np.sqrt(3.0) - 2.0
    if n == 1:
        return a.astype(float)
    c = a.astype(float) * 6.0
    powers = pole ** np.arange(2 * n - 2)
    around = np.concatenate([c, c[..., -2:0:-1]], axis=-1)
    c[..., 0] = (around * powers).sum(-1) / (1 - pole ** (2 * n - 2))
    for k in range(1, n):
        c[..., k] += pole * c[..., k - 1]
    c[..., -1] = pole / (pole * pole - 1) * (c[..., -1] + pole * c[..., -2])
    for k in range(n - 2, -1, -1):
        c[..., k] = pole * (c[..., k + 1] - c[..., k])
    return c


def _spline_weights(t: np.ndarray) -> list[np.ndarray]:
    return [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6]


def resize_cubic(a: np.ndarray, shape: tuple[int, ...], anti_alias: bool = True) -> np.ndarray:
    """Cubic spline interpolation at the centres of the new cells; axes that shrink are smoothed before."""
    out = a.astype(float)
    for axis, m in enumerate(shape):
        n = out.shape[axis]
        if n == m:
            continue
        moved = np.moveaxis(out, axis, -1)
        if anti_alias and m < n:
            w = np.array(gaussian_weights((n / m - 1) / 2)) if n / m > 1.25 else np.ones(1)
            r = len(w) // 2
            p = np.pad(moved, [(0, 0)] * (moved.ndim - 1) + [(r, r)], "reflect" if n > r else "symmetric")
            moved = sum(x * p[..., k : k + n] for k, x in enumerate(w))
        c = _spline_coefficients(moved)
        at = (np.arange(m) + 0.5) * n / m - 0.5
        base = np.floor(at).astype(int)
        period = max(2 * (n - 1), 1)
        got = 0
        for k, w in enumerate(_spline_weights(at - base)):
            q = np.abs((base - 1 + k) % period)
            q = np.where(q >= n, period - q, q)
            got = got + w * c[..., q]
        out = np.moveaxis(got, -1, axis)
    return out


def resize_volumes(voxels: DataFrame, shape: tuple[int, int, int], anti_alias: bool = True) -> DataFrame:
    """Cubic resampling of each volume."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        _, (a,) = _dense(frame, ["value"])
        out = resize_cubic(a, shape, anti_alias)
        where = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({"volume_id": frame.volume_id.iloc[0], "z": where[0], "y": where[1], "x": where[2], "value": out.ravel()})

    return voxels.select("volume_id", *AXES, "value").groupBy("volume_id").applyInPandas(one, _SCHEMA)


def map_volumes(voxels: DataFrame, work) -> DataFrame:
    """Any function of a dense array, volume by volume."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        at, (a,) = _dense(frame, ["value"])
        return frame.assign(value=work(a)[tuple(at.T)])

    return voxels.select("volume_id", *AXES, "value").groupBy("volume_id").applyInPandas(one, _SCHEMA)


# ---- flooding


def _faces(ndim: int) -> list[tuple[int, ...]]:
    return [tuple(s if k == a else 0 for k in range(ndim)) for a in range(ndim) for s in (-1, 1)]


def reconstruct(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Greyscale reconstruction of the mask by dilation of the marker, over faces (a flood in order of height)."""
    out = np.minimum(marker, mask).astype(float)
    heap = [(-v, i) for i, v in enumerate(out.ravel())]
    heapq.heapify(heap)
    flat, top, shape = out.ravel(), mask.ravel(), out.shape
    done = np.zeros(out.size, bool)
    while heap:
        v, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = True
        at = np.unravel_index(i, shape)
        for d in _faces(out.ndim):
            q = tuple(a + b for a, b in zip(at, d))
            if all(0 <= a < n for a, n in zip(q, shape)):
                j = int(np.ravel_multi_index(q, shape))
                new = min(flat[i], top[j])
                if not done[j] and new > flat[j]:
                    flat[j] = new
                    heapq.heappush(heap, (-new, j))
    return flat.reshape(shape)


def label_faces(mask: np.ndarray) -> np.ndarray:
    """Face-connected components, numbered by their first cell."""
    out = np.zeros(mask.shape, int)
    n = 0
    for at in map(tuple, np.argwhere(mask)):
        if not out[at]:
            n += 1
            todo = [at]
            out[at] = n
            while todo:
                p = todo.pop()
                for d in _faces(mask.ndim):
                    q = tuple(a + b for a, b in zip(p, d))
                    if all(0 <= a < s for a, s in zip(q, mask.shape)) and mask[q] and not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


def dome_seeds(f: np.ndarray, h: float) -> np.ndarray:
    """Components of the regional domes of height h; domes of cells at or below h do not count."""
    residue = f - reconstruct(f - h, f)
    residue[f <= h] = 0
    return label_faces(residue > 1e-12)


def flood(height: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Marker watershed over faces within the mask: lowest cells first, of equal ones the first to be reached."""
    out = np.where(mask, seeds, 0)
    heap, turn = [], 0
    for at in map(tuple, np.argwhere(out > 0)):
        heapq.heappush(heap, (height[at], turn, at))
        turn += 1
    while heap:
        _, _, p = heapq.heappop(heap)
        for d in _faces(out.ndim):
            q = tuple(a + b for a, b in zip(p, d))
            if all(0 <= a < s for a, s in zip(q, out.shape)) and mask[q] and not out[q]:
                out[q] = out[p]
                turn += 1
                heapq.heappush(heap, (height[q], turn, q))
    return out


def sobel(a: np.ndarray) -> list[np.ndarray]:
    """Differences along each axis, smoothed by 1 2 1 along the others; edges mirrored with the edge repeated."""
    out = []
    for axis in range(a.ndim):
        g = a.astype(float)
        for other in range(a.ndim):
            p = np.pad(g, [(1, 1) if k == other else (0, 0) for k in range(a.ndim)], "symmetric")
            n = a.shape[other]
            below, here, above = (np.take(p, np.arange(k, k + n), other) for k in range(3))
            g = above - below if other == axis else below + 2 * here + above
        out.append(g)
    return out


def symmetry(a: np.ndarray, background: float = 0.05, radii: tuple[float, ...] = (7, 9, 11, 13), sigma: float = 0.5) -> np.ndarray:
    """Smoothed votes for centres of symmetry, each radius scaled to [0, 1], averaged; 0 where the image is background (see stencil.multi_scale_symmetry)."""
    gradient = sobel(a)
    norm = np.sqrt(sum(g**2 for g in gradient))
    on = np.argwhere(norm > 1e-8)
    step = np.stack([g[tuple(on.T)] / norm[tuple(on.T)] for g in gradient], axis=1)
    total = np.zeros(a.shape)
    for r in radii:
        votes = np.zeros(a.shape)
        for sign in (1, -1):
            to = np.rint(on + sign * r * step).astype(int)
            to = to[((to >= 0) & (to < a.shape)).all(axis=1)]
            np.add.at(votes, tuple(to.T), sign)
        votes = smooth(votes, sigma)
        span = votes.max() - votes.min()
        total += (votes - votes.min()) / span if span else 0.0
    return np.where(a > background, total / len(radii), 0.0)


def segment(
    f: np.ndarray,
    h: float = 0.1,
    background: float = 0.2,
    confidence: float = 0.5,
    min_size: int = 9,
    smoothing: bool = True,
    simple: bool = False,
    sym: bool = False,
) -> np.ndarray:
    """Instances of a predicted heat map: seeds, watershed, and a filter by size and peak.

    Smoothing (and rescaling to [0, 1]) and symmetry votes are for the domes
    alone. Which of them count as seeds, where the flood goes and in which
    order, and which instances stay is up to the prediction as it is.
    """
    dome = f.astype(float)
    if smoothing:
        dome = smooth(dome, 1.0)
        dome = (dome - dome.min()) / (dome.max() - dome.min() + 1e-8) if dome.max() != dome.min() else np.zeros(f.shape)
    if dome.sum() == 0:
        return np.zeros(f.shape, int)
    if simple:
        seeds = label_faces(dome > h)
    else:
        dome = symmetry(dome) if sym else dome
        seeds = label_faces((dome - reconstruct(dome - h, dome) > 1e-12) & (f > h))
    found = flood(-f, seeds, f > background)
    size = np.bincount(found.ravel())
    peak = np.full(len(size), -np.inf)
    np.maximum.at(peak, found.ravel(), f.ravel())
    good = (size > min_size) & (peak > confidence)
    good[0] = False
    return np.where(good, np.cumsum(good), 0)[found]


def _by_volume(voxels: DataFrame, columns: list[str], work, out: str = "label") -> DataFrame:
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        at, arrays = _dense(frame, columns)
        return pd.DataFrame({"volume_id": frame.volume_id, "z": frame.z, "y": frame.y, "x": frame.x, out: work(*arrays)[tuple(at.T)]})

    return voxels.select("volume_id", *AXES, *columns).groupBy("volume_id").applyInPandas(one, f"volume_id string, z int, y int, x int, {out} int")


def dome_seed_labels(voxels: DataFrame, h: float) -> DataFrame:
    return _by_volume(voxels, ["value"], lambda f: dome_seeds(f, h))


def watershed(voxels: DataFrame, background: float) -> DataFrame:
    """voxels: value and seed labels in label; floods -value where value > background."""
    return _by_volume(voxels, ["value", "label"], lambda f, s: flood(-f, s, f > background))


def segment_volumes(voxels: DataFrame, padding: Sequence[tuple[int, int]] | None = None, **settings) -> DataFrame:
    """The instances of each volume.

    With ``padding`` (before and after, for each axis) a volume that turns out
    empty before any seed is looked for loses that much on each side, as a
    caller who pads volumes may expect; others are as large as they were.
    """
    sides = padding if padding is not None and any(n for pair in padding for n in pair) else None

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        at, (f,) = _dense(frame, ["value"])
        found = segment(f, **settings)
        out = pd.DataFrame({"volume_id": frame.volume_id, "z": frame.z, "y": frame.y, "x": frame.x, "label": found[tuple(at.T)]})
        if sides is None or found.any() or not _empty(f, settings.get("smoothing", True)):
            return out
        low, high = np.array([a for a, _ in sides]), np.array(f.shape) - [b for _, b in sides]
        out[list(AXES)] -= low
        return out[((at >= low) & (at < high)).all(axis=1)]

    return voxels.select("volume_id", *AXES, "value").groupBy("volume_id").applyInPandas(one, "volume_id string, z int, y int, x int, label int")


def _empty(f: np.ndarray, smoothing: bool) -> bool:
    return f.max() == f.min() if smoothing else f.sum() == 0
