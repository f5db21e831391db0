"""Splits, mini-batches, crop centres, augmentation and parameter search, all seeded by keys."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AXES


def _key(*keys) -> F.Column:
    """Keys (columns or their names; literals as F.lit) as one string, null as an empty one."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def order(*keys) -> F.Column:
    """A string that sorts rows at random, by the keys alone: their MD5, which other engines have as well."""
    return F.md5(_key(*keys).cast("binary"))


def uniform(*keys) -> F.Column:
    """A number in [0, 1) that depends on the keys alone: the first 52 bits of their MD5."""
    return F.conv(F.substring(order(*keys), 1, 13), 16, 10).cast("double") / float(1 << 52)


def below(n: int, *keys) -> F.Column:
    """A whole number in [0, n) that depends on the keys alone."""
    return F.floor(uniform(*keys) * n).cast("int")


def normal(*keys) -> F.Column:
    """A standard normal number that depends on the keys alone (Box and Muller)."""
    a, b = uniform(*keys, F.lit("a")), uniform(*keys, F.lit("b"))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(b * 6.283185307179586)


def minibatch(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in a random order; a top-n, so no full sort."""
    return rows.orderBy(order(key, F.lit(seed)), key).limit(n)


def split(volumes: DataFrame, held: DataFrame) -> DataFrame:
    """Adds role: that of ``held`` (ordinal, role) where it names the volume, train elsewhere."""
    return volumes.join(held, "ordinal", "left").withColumn("role", F.coalesce("role", F.lit("train")))


def train_part(volumes: DataFrame, *held: DataFrame) -> DataFrame:
    """Volumes that none of the lists names."""
    out = volumes
    for h in held:
        out = out.join(h.select("ordinal"), "ordinal", "left_anti")
    return out


def picks(volumes: DataFrame, indices: Sequence[int], spark: SparkSession) -> DataFrame:
    """Volumes by their ordinals, in the order of the list, repeated ones too, with their place in it."""
    wanted = spark.createDataFrame([(k, int(i)) for k, i in enumerate(indices)], "pick int, ordinal int")
    return volumes.join(wanted, "ordinal")


def crop_centres(candidates: DataFrame, draws: int, half: int, shape: Sequence[int], seed: int) -> DataFrame:
    """Crop centres (volume_id, draw, kind, cz, cy, cx) for each volume, so many draws.

    candidates: volume_id, kind (instance, background, foreground), z, y, x.
    Half of the draws take an instance's median, a tenth each a hard place in
    background and foreground, all with jitter, the rest a place at random;
    so does a draw whose kind has no candidate. Centres are kept inside.
    """
    jitter = max(half // 4, 2)
    volumes = candidates.select("volume_id").distinct()
    drawn = volumes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform("volume_id", "draw", F.lit(seed), F.lit("kind"))
    kind = F.when(u < 0.5, "instance").when(u < 0.8, "uniform").when(u < 0.9, "background").otherwise("foreground")
    drawn = drawn.withColumn("kind", kind)
    # A candidate wins a draw by the least hash; aggregated, so no list of candidates is gathered.
    met = drawn.join(candidates.select("volume_id", "kind", *AXES), ["volume_id", "kind"])
    turn = order("volume_id", "draw", F.lit(seed), *AXES)
    won = met.groupBy("volume_id", "draw").agg(F.min(F.struct(turn.alias("o"), *AXES)).alias("c"))
    out = drawn.join(won, ["volume_id", "draw"], "left")
    place = {}
    for a, n in zip(AXES, shape):
        move = F.floor(uniform("volume_id", "draw", F.lit(seed), F.lit(f"j{a}")) * (2 * jitter + 1)) - jitter
        free = F.floor(uniform("volume_id", "draw", F.lit(seed), F.lit(f"u{a}")) * max(n - 2 * half, 1)) + half
        c = F.coalesce(F.col(f"c.{a}") + move, free)
        place[f"c{a}"] = F.least(F.greatest(c, F.lit(min(half, n // 2))), F.lit(max(n - half, n // 2))).cast("int")
    return out.select("volume_id", "draw", F.when(F.col("c").isNull(), "uniform").otherwise(F.col("kind")).alias("kind"), *[v.alias(k) for k, v in place.items()])


def add_noise(voxels: DataFrame, seed: int, chance: float = 0.2, sigma: float = 0.3) -> DataFrame:
    """Gaussian noise, clamped to [0, 1], on a share of the volumes."""
    on = uniform("volume_id", F.lit(seed), F.lit("noise")) < chance
    noisy = F.least(F.greatest(F.col("value") + sigma * normal("volume_id", *AXES, F.lit(seed)), F.lit(0.0)), F.lit(1.0))
    return voxels.withColumn("value", F.when(on, noisy).otherwise(F.col("value")))


def motion_blur(voxels: DataFrame, shape: Sequence[int], seed: int, chance: float = 0.2, side: int = 3) -> DataFrame:
    """Blurs a share of the volumes along a line, of an angle from 1 to 59 degrees in a plane drawn for each of them; adds blur (the angle, null where there is none) and plane.

    A volume of one layer is blurred by the kernel of images. Draws depend on
    volume_id and the seed alone.
    """
    from .stencil import PLANES, motion_kernel, motion_kernel_2d, shifted_sum

    on = uniform("volume_id", F.lit(seed), F.lit("blur")) < chance
    angle = below(59, "volume_id", F.lit(seed), F.lit("angle")) + 1
    plane = below(len(PLANES), "volume_id", F.lit(seed), F.lit("plane"))
    flat = min(shape) == 1
    drawn = voxels.withColumn("blur", F.when(on, angle)).withColumn("plane", F.when(on & F.lit(not flat), plane))
    if flat:
        return shifted_sum(drawn, motion_kernel_2d(side), shape, F.col("blur").isNotNull(), keep=("blur", "plane"))
    # Every voxel sends itself with the kernel of its own volume: the offsets are the same, the weights are worked out from angle and plane.
    cos, sin, none = F.cos(F.radians("blur")), F.sin(F.radians("blur")), F.lit(0.0)
    p = F.col("plane")
    along = {"z": F.when(p < 2, cos).otherwise(none), "y": F.when(p == 0, sin).when(p == 2, cos).otherwise(none), "x": F.when(p > 0, sin).otherwise(none)}
    drawn = drawn.withColumns({f"_{a}": c for a, c in along.items()})
    places = [(z, y, x) for z, y, x, _ in motion_kernel(0.0, side=side)]
    weight = [F.sqrt((F.col("_z") * z) ** 2 + (F.col("_y") * y) ** 2 + (F.col("_x") * x) ** 2) for z, y, x in places]
    drawn = drawn.withColumn("_total", sum(weight[1:], weight[0]))
    return shifted_sum(drawn, [(*q, w / F.col("_total")) for q, w in zip(places, weight)], shape, F.col("blur").isNotNull(), keep=("blur", "plane"))


def cue(voxels: DataFrame, seed: int, chance: float = 0.2, empty: float = -5.0) -> DataFrame:
    """Adds cue: on a share of the volumes that have more than one label, the heat of one label drawn at random, ``empty`` elsewhere."""
    some = voxels.filter("label <> 0").select("volume_id", "label").distinct()
    picked = some.groupBy("volume_id").agg(F.count("*").alias("_n"), F.min_by("label", order("volume_id", "label", F.lit(seed))).alias("_pick"))
    on = (F.col("_n") > 1) & (uniform("volume_id", F.lit(seed), F.lit("cue")) < chance) & (F.col("label") == F.col("_pick"))
    return voxels.join(picked, "volume_id", "left").withColumn("cue", F.when(on, F.col("value")).otherwise(F.lit(empty))).drop("_n", "_pick")


def rotate_crops(rows: DataFrame, seed: int) -> DataFrame:
    """Quarter turns of 2-D images (z constant) by volume, the same for all columns; adds angle. Images must be square, of ``side``."""
    k = below(4, "volume_id", F.lit(seed))
    y, x, m = F.col("y"), F.col("x"), F.col("side") - 1
    turned = rows.withColumn("_k", k)
    ny = F.when(F.col("_k") == 1, m - x).when(F.col("_k") == 2, m - y).when(F.col("_k") == 3, x).otherwise(y)
    nx = F.when(F.col("_k") == 1, y).when(F.col("_k") == 2, m - x).when(F.col("_k") == 3, m - y).otherwise(x)
    return turned.withColumns({"y": ny.cast("int"), "x": nx.cast("int"), "angle": F.col("_k") * 90}).drop("_k")


def grid(spark: SparkSession, space: dict[str, Sequence], most: int | None = None, seed: int = 0) -> DataFrame:
    """Trials: all combinations of a space of parameters, or ``most`` of them at random."""
    names = list(space)
    rows = [(k, *c) for k, c in enumerate(itertools.product(*space.values()))]
    out = spark.createDataFrame(rows, ["trial_id", *names])
    return minibatch(out, most, seed, "trial_id") if most else out


def tune(volumes: DataFrame, trials: DataFrame, columns: Sequence[str], score: Callable[[dict, pd.DataFrame], float], tasks: int = 8) -> DataFrame:
    """(trial_id, score): the score of each trial averaged over volumes; a failing trial scores 0.

    volumes: volume_id and a row for each voxel. The trials, a stated list of
    parameters, go with the code, ``tasks`` parts of them each with a copy of
    the voxels: a group is a volume with a part of the trials.
    """
    names = [c for c in trials.columns if c != "trial_id"]
    listed = [(r["trial_id"], {n: r[n] for n in names}) for r in trials.collect()]
    parts = max(1, min(tasks, len(listed)))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        part, out = int(frame["part"].iloc[0]), []
        for trial_id, settings in listed[part::parts]:
            try:
                s = float(score(settings, frame))
            except Exception:
                s = 0.0
            out.append((trial_id, frame.volume_id.iloc[0], s))
        return pd.DataFrame(out, columns=["trial_id", "volume_id", "score"])

    table = volumes.select("volume_id", *columns, F.explode(F.array(*[F.lit(k) for k in range(parts)])).alias("part"))
    each = table.groupBy("volume_id", "part").applyInPandas(one, "trial_id long, volume_id string, score double")
    return each.groupBy("trial_id").agg(F.avg("score").alias("score"))


def objective(frame: pd.DataFrame, settings: dict, thresholds: Sequence[float]) -> float:
    """Accuracy of a segmentation, averaged over thresholds of IoU; frame: z, y, x, value and the true label."""
    import numpy as np

    from .matching import best_pairs
    from .volume_udf import _dense, segment

    at, (f, t) = _dense(frame, ["value", "label"])
    got = segment(f, **settings)[tuple(at.T)]
    true = t[tuple(at.T)]
    pairs = pd.DataFrame({"t": true, "p": got})
    n = pairs.groupby(["t", "p"]).size().rename("n").reset_index()
    n["score"] = n.n / (n.groupby("t").n.transform("sum") + n.groupby("p").n.transform("sum") - n.n)
    inner = n[(n.t > 0) & (n.p > 0)]
    n_true, n_pred = len(np.unique(true[true > 0])), len(np.unique(got[got > 0]))
    total = 0.0
    for thr in thresholds:
        tp = int(best_pairs(inner, min(n_true, n_pred), [thr]).is_match.sum()) if len(inner) else 0
        total += tp / (n_true + n_pred - tp) if tp else 0.0
    return total / len(thresholds)


#: Thresholds that trials are scored at, by the dimension of the images.
TRIAL_THRESHOLDS = {3: [k / 10 for k in range(1, 10)], 2: [k / 20 for k in range(10, 20)]}
#: What trials are drawn from: first and last value and step, or a list.
TRIAL_SPACE = {"h": (0.15, 0.5, 0.01), "background": (0.05, 0.25, 0.01), "confidence": (0.2, 0.75, 0.01), "smoothing": [True, False], "simple": [True, False]}


def random_trials(spark: SparkSession, n: int = 300, seed: int = 0, space: dict = TRIAL_SPACE) -> DataFrame:
    """n trials, each parameter drawn from its values by trial and seed."""
    out = spark.range(n).withColumnRenamed("id", "trial_id")
    for name, values in space.items():
        if isinstance(values, tuple):
            low, high, step = values
            values = [round(low + k * step, 9) for k in range(round((high - low) / step) + 1)]
        out = out.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), below(len(values), "trial_id", F.lit(seed), F.lit(name))))
    return out


def tune_segmentation(volumes: DataFrame, trials: DataFrame, dimension: int = 3) -> DataFrame:
    """(trial_id, score) of settings of ``volume_udf.segment``; volumes: volume_id, z, y, x, value and the true label."""
    levels = TRIAL_THRESHOLDS[dimension]
    return tune(volumes, trials, [*AXES, "value", "label"], lambda settings, frame: objective(frame, settings, levels))


def best_trial(scored: DataFrame, trials: DataFrame) -> DataFrame:
    """The parameters of the best trial, the first of equal ones."""
    top = scored.agg(F.max(F.struct("score", (-F.col("trial_id")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("trial_id"), F.col("b.score").alias("score"))
    return trials.join(F.broadcast(top), "trial_id")
