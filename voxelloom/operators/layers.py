"""Layers of networks that have a relational form; learned ones are left to a model (see inference.predict)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumsum(rows: DataFrame, item: str, order: str, value: str, out: str = "cumsum") -> DataFrame:
    w = Window.partitionBy(item).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(w))


def row_max(rows: DataFrame, item: str, order: str, value: str, out: str = "row_max") -> DataFrame:
    """The largest value so far."""
    w = Window.partitionBy(item).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.max(value).over(w))


def causal_conv(rows: DataFrame, item: str, order: str, value: str, weights: Sequence[float], out: str = "conv") -> DataFrame:
    """Weighted sum of a value and those before it (weights: oldest first); what is missing counts as 0."""
    w = Window.partitionBy(item).orderBy(order)
    k = len(weights)
    terms = [F.coalesce(F.lag(value, k - 1 - j).over(w), F.lit(0.0)) * F.lit(float(x)) for j, x in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return rows.withColumn(out, total)


def _joined(rows: DataFrame, keys: Sequence[str], *aggregates) -> DataFrame:
    return rows.join(rows.groupBy(*keys).agg(*aggregates), list(keys))


def layer_norm(rows: DataFrame, item: str, value: str, eps: float = 1e-5, out: str = "norm") -> DataFrame:
    v = _joined(rows, [item], F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return v.withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def filter_response_norm(rows: DataFrame, keys: Sequence[str], value: str, gamma: float = 1.0, beta: float = 0.0, tau: float = 0.0, eps: float = 1e-6, learned_eps: float = 0.0, out: str = "frn") -> DataFrame:
    """max(gamma x / sqrt(mean x^2 + |eps|) + beta, tau) over an item's channel; with an empty list of keys over each value alone."""
    if keys:
        v = _joined(rows, keys, F.avg(F.col(value) ** 2).alias("_n"))
    else:
        v = rows.withColumn("_n", F.col(value) ** 2)
    y = F.lit(gamma) * F.col(value) / F.sqrt(F.col("_n") + abs(learned_eps) + eps) + beta
    return v.withColumn(out, F.greatest(y, F.lit(tau))).drop("_n")


def mish_response_norm(rows: DataFrame, keys: Sequence[str], value: str, tau: float = 0.0, out: str = "frn_mish", **options) -> DataFrame:
    """The same with y tanh(softplus(y - tau)) for the maximum."""
    v = filter_response_norm(rows, keys, value, tau=-math.inf, out="_y", **options)
    y = F.col("_y")
    return v.withColumn(out, y * F.tanh(F.log1p(F.exp(y - tau)))).drop("_y")


def log_sigmoid_gates(rows: DataFrame, item: str, order: str, gate: str) -> DataFrame:
    """Adds log_f, the running sum of log sigmoid of a gate, as the parallel form of a matrix memory needs it."""
    g = F.col(gate)
    return cumsum(rows.withColumn("_l", -F.log1p(F.exp(-F.abs(g))) + F.least(g, F.lit(0.0))), item, order, "_l", "log_f").drop("_l")


def matrix_memory(q: np.ndarray, k: np.ndarray, v: np.ndarray, i: np.ndarray, f: np.ndarray, eps: float = 1e-6, chunk: int = 64) -> np.ndarray:
    """The output of a matrix memory cell (the mLSTM of Beck et al., 2024) for (steps, size) queries, keys, values and gates.

    Steps go in chunks: within a chunk all pairs are weighed at once, and what
    came before is in a state, a matrix of size x size and a vector, scaled by
    the exponential of ``height``. So memory does not grow with steps squared.
    """
    steps, size = q.shape
    out = np.empty_like(v, float)
    memory, norm, height = np.zeros((size, v.shape[1])), np.zeros(size), -np.inf
    for at in range(0, steps, chunk):
        part = slice(at, min(at + chunk, steps))
        qs, ks, vs = q[part] / math.sqrt(size), k[part], v[part]
        fade = np.cumsum(np.minimum(f[part], 0) - np.log1p(np.exp(-np.abs(f[part]))))
        gain = i[part] - fade  # of an input, as seen from where the chunk begins
        best = np.maximum(np.maximum.accumulate(gain), height)
        scale = np.exp(np.where(np.tri(len(fade), dtype=bool), gain[None, :] - best[:, None], -np.inf))
        old = np.exp(height - best)[:, None]
        weight = qs @ ks.T * scale
        value = weight @ vs + old * (qs @ memory)
        total = weight.sum(1) + old[:, 0] * (qs @ norm)
        out[part] = value / (np.maximum(np.abs(total), np.exp(-(best + fade))) + eps)[:, None]
        last = np.exp(gain - best[-1])
        memory = (ks * last[:, None]).T @ vs + np.exp(height - best[-1]) * memory
        norm = last @ ks + np.exp(height - best[-1]) * norm
        height = best[-1] + fade[-1]
    return out


def route(votes: DataFrame, iterations: int = 3) -> DataFrame:
    """Routing by agreement: votes (item, child, parent, vote array) to parents (item, parent, pose).

    Logits grow by the product of vote and pose; weights are their softmax over
    a child's parents. An item's children are few, so windows stay small.
    """
    from ..functions.scalar import squash

    dot = F.expr("aggregate(zip_with(vote, pose, (a, b) -> a * b), 0D, (s, x) -> s + x)")
    v = votes.withColumn("logit", F.lit(0.0))
    child = Window.partitionBy("item", "child")
    size = votes.select(F.size("vote")).first()
    n = size[0] if size else 0
    pose = None
    for turn in range(iterations):
        weighted = v.withColumn("c", F.exp("logit") / F.sum(F.exp("logit")).over(child))
        sums = weighted.groupBy("item", "parent").agg(F.array(*[F.sum(F.col("c") * F.col("vote")[j]) for j in range(n)]).alias("s"))
        pose = sums.select("item", "parent", squash(F.col("s")).alias("pose"))
        if turn + 1 < iterations:
            v = v.join(pose, ["item", "parent"]).withColumn("logit", F.col("logit") + dot).drop("pose")
    return pose


#: Phases by mode, of the frequency along z and the distance from frequency 0: piston, tilt, defocus, spherical.
ZERNIKE = {
    0: lambda z, r: np.ones_like(r),
    3: lambda z, r: z,
    4: lambda z, r: 2 * r**2 - 1,
    12: lambda z, r: 6 * r**4 - 6 * r**2 + 1,
}


def zernike_filter(volume: np.ndarray, alphas: dict[int, float]) -> np.ndarray:
    """Turns the spectrum of a volume by phases of modes with amplitudes 2 tanh(alpha), over frequencies in cycles a cell; a mode that is not known has no phase."""
    spectrum = np.fft.rfftn(volume)
    grids = np.meshgrid(*[np.fft.fftfreq(n) for n in volume.shape[:-1]], np.fft.rfftfreq(volume.shape[-1]), indexing="ij")
    r = np.sqrt(sum(g**2 for g in grids))
    phase = sum(2 * math.tanh(a) * ZERNIKE[m](grids[0], r) for m, a in alphas.items() if m in ZERNIKE)
    return np.fft.irfftn(spectrum * np.exp(1j * phase), volume.shape)


def zernike_image(image: np.ndarray, tilt: float = 2.0, defocus: float = 2.0, spherical: float = -2.0) -> np.ndarray:
    """A square image with the phases of three modes on its spectrum, scaled to [0, 1]; the tilt is relative to the highest frequency."""
    n = len(image)
    f = np.fft.fftfreq(n)
    y, x = np.meshgrid(f, f, indexing="ij")
    r = np.clip(np.hypot(y, x), 0, 1)
    phase = tilt * y / np.abs(f).max() + defocus * ZERNIKE[4](y, r) + spherical * ZERNIKE[12](y, r)
    out = np.fft.ifft2(np.fft.fft2(image) * np.exp(1j * phase)).real
    return (out - out.min()) / (out.max() - out.min()) if out.max() > out.min() else np.zeros_like(out)


def linear_headwise(rows: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """A linear map of each head's part of the last axis: weight (heads, out, in); heads do not mix."""
    heads, size_out, size_in = weight.shape
    parts = rows.reshape(*rows.shape[:-1], heads, size_in)
    out = np.einsum("...hi,hoi->...ho", parts, weight).reshape(*rows.shape[:-1], heads * size_out)
    return out if bias is None else out + bias


def multi_head_norm(rows: DataFrame, item: Sequence[str], head: str, value: str, eps: float = 1e-5, out: str = "norm") -> DataFrame:
    """Layer norm within each head of an item."""
    v = _joined(rows, [*item, head], F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return v.withColumn(out, (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def initial(kind: str, shape: tuple[int, ...], seed: int, dim: int = 1, blocks: int = 1, start: float = 3.4, end: float = 6.0, std: float = 0.02) -> np.ndarray:
    """First values of weights.

    truncated: normal with deviation ``std``, cut at two of them; small: normal
    with sqrt(2 / (5 dim)) (Nguyen and Salazar, 2019); wang: normal with
    2 / (blocks sqrt(dim)); spaced: from start to end along the last axis.
    """
    rng = np.random.default_rng(seed)
    if kind == "spaced":
        return np.broadcast_to(np.linspace(start, end, shape[-1]), shape).copy()
    if kind == "truncated":
        out = rng.standard_normal(shape)
        while (far := np.abs(out) >= 2).any():
            out[far] = rng.standard_normal(int(far.sum()))
        return std * out
    scale = {"small": math.sqrt(2 / (5 * dim)), "wang": 2 / (blocks * math.sqrt(dim))}
    if kind not in scale:
        raise ValueError(f"no such start: {kind}")
    return scale[kind] * rng.standard_normal(shape)


def drop_path(rows: DataFrame, item: str, value: str, residual: str, chance: float, seed: int, scaled: bool = True, out: str = "dropped") -> DataFrame:
    """value + residual for a share of the items drawn by item and seed, value alone for the others; what stays is scaled so that its mean holds."""
    from .sampling import uniform

    if not 0 <= chance < 1:
        raise ValueError("chance must be in [0, 1)")
    kept = uniform(item, F.lit(seed), F.lit("path")) >= chance
    return rows.withColumn(out, F.col(value) + F.when(kept, F.col(residual) * (1 / (1 - chance) if scaled else 1.0)).otherwise(F.lit(0.0)))


def traverse(rows: DataFrame, item: str, order: str, backwards: bool, out: str = "turn") -> DataFrame:
    """The turn in which a layer takes each step of an item: from the first to the last, or from the last to the first."""
    column = F.col(order)
    window = Window.partitionBy(item).orderBy(column.desc() if backwards else column.asc())
    return rows.withColumn(out, F.row_number().over(window) - 1)


def spectral_dropout(spectrum: np.ndarray, chance: float, seed: int) -> np.ndarray:
    """Sets a share of the frequencies to 0, never the one that holds the mean."""
    keep = np.random.default_rng(seed).random(spectrum.shape) >= chance
    keep[..., 0, 0, 0] = True
    return spectrum * keep
