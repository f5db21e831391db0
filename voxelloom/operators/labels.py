"""Label volumes: renumbering, instance tables, filters, components, descent basins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import AXES

PLACE = ("volume_id", *AXES)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; where that is unset, in one of our own if all runs on one machine, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="voxelloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _save(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder."""
    path = shared_folder(df.sparkSession, name) + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- renumbering


def label_map(labels: DataFrame, offset: int = 1, group: str | None = "volume_id") -> DataFrame:
    """(volume_id, label, new): dense numbers from offset in the order of labels; 0 stays 0.

    Only distinct labels are numbered, so the window holds the instances of a
    volume, not its voxels. Without a group they are numbered range by range,
    each from the number of labels in the ranges before.
    """
    if offset < 1:
        raise ValueError("offset must be positive")
    keys = [group] if group else []
    distinct = labels.filter("label <> 0").select(*keys, "label").distinct()
    if keys:
        return distinct.withColumn("new", (F.row_number().over(Window.partitionBy(*keys).orderBy("label")) + (offset - 1)).cast("int"))
    ranges = _save(distinct.repartitionByRange("label").withColumn("_range", F.spark_partition_id()), "labels")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("label")) + F.col("_start") + (offset - 1)
    return ranges.join(starts, "_range").select("label", number.cast("int").alias("new"))


def relabel(labels: DataFrame, offset: int = 1, group: str | None = "volume_id") -> DataFrame:
    """The volume with dense labels."""
    return apply_map(labels, label_map(labels, offset, group), group)


def apply_map(labels: DataFrame, mapping: DataFrame, group: str | None = "volume_id") -> DataFrame:
    """Looks labels up in a map (label, new); labels that it lacks become 0."""
    keys = [group, "label"] if group else ["label"]
    return labels.join(mapping, keys, "left").select(*[F.coalesce("new", F.lit(0)).cast("int").alias("label") if c == "label" else F.col(c) for c in labels.columns])


def inverse_map(mapping: DataFrame) -> DataFrame:
    return mapping.select(*[c for c in mapping.columns if c not in ("label", "new")], F.col("new").alias("label"), F.col("label").alias("old"))


def shuffle_labels(labels: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation of the labels of each volume, by a hash of label and seed; 0 stays 0."""
    from .sampling import order

    distinct = labels.filter("label <> 0").select("volume_id", "label").distinct()
    a = distinct.withColumn("_k", F.row_number().over(Window.partitionBy("volume_id").orderBy("label")))
    b = distinct.withColumn("_k", F.row_number().over(Window.partitionBy("volume_id").orderBy(order("label", F.lit(seed)), "label")))
    return apply_map(labels, a.join(b.withColumnRenamed("label", "new"), ["volume_id", "_k"]).drop("_k"))


# ---- instances


def boxes(labels: DataFrame) -> DataFrame:
    """Size and bounding box (both ends included) of each instance."""
    ends = [f(a).alias(f"{a}_{n}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    return labels.filter("label <> 0").groupBy("volume_id", "label").agg(F.count("*").alias("n_vox"), *ends)


def medians(labels: DataFrame) -> DataFrame:
    """Median coordinates of each instance, cut to whole numbers."""
    return labels.filter("label <> 0").groupBy("volume_id", "label").agg(*[F.expr(f"cast(percentile({a}, 0.5d) as int)").alias(a) for a in AXES])


def counts(labels: DataFrame) -> DataFrame:
    """Number of instances of each volume."""
    return labels.groupBy("volume_id").agg(F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("n_instances"))


def total_objects(labels: DataFrame) -> DataFrame:
    """Sum over volumes of the largest label."""
    return labels.groupBy("volume_id").agg(F.max("label").alias("m")).agg(F.sum("m").alias("n_objects"))


def filter_instances(labels: DataFrame, min_size: int = 9, min_peak: float = 0.5, value: str = "value") -> DataFrame:
    """Keeps instances of more than min_size voxels whose largest value is over min_peak, with dense labels in the old order."""
    good = labels.filter("label <> 0").groupBy("volume_id", "label").agg(F.count("*").alias("n"), F.max(value).alias("peak")).filter((F.col("n") > min_size) & (F.col("peak") > min_peak))
    return apply_map(labels, label_map(good.select("volume_id", "label")))


# ---- components


def components(mask: DataFrame, name: str = "components") -> DataFrame:
    """Labels of face-connected sets of voxels with value > 0; numbered by their first voxel in z, y, x order. Others are 0.

    Runs along x are made by windows first; a run, not a voxel, is a vertex.
    Labels spread along the edges between runs and are then replaced by the
    labels of their labels, so the number of rounds grows with the logarithm
    of a component's width. Each round is written to the shared folder.
    """
    on = mask.filter("value > 0").select(*PLACE)
    line = Window.partitionBy("volume_id", "z", "y").orderBy("x")
    runs = on.withColumn("_r", F.col("x") - F.row_number().over(line))
    table = runs.groupBy("volume_id", "z", "y", "_r").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # A run is named by its first voxel; order of names is the order of voxels.
    node = F.struct("z", "y", F.col("a").alias("x"))
    voxel = _save(runs.join(table, ["volume_id", "z", "y", "_r"]).select(*PLACE, node.alias("v")), f"{name}-voxels")
    edges = None
    for axis in ("z", "y"):
        other = voxel.select("volume_id", *[(F.col(a) - 1).alias(a) if a == axis else F.col(a) for a in AXES], F.col("v").alias("u"))
        e = voxel.join(other, list(PLACE)).select("volume_id", "v", "u").distinct()
        edges = e if edges is None else edges.union(e)
    both = _save(edges.union(edges.select("volume_id", F.col("u").alias("v"), F.col("v").alias("u"))), f"{name}-edges")
    labels = _save(voxel.select("volume_id", "v").distinct().withColumn("c", F.col("v")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select("volume_id", F.col("v").alias("u"), F.col("c").alias("d")), ["volume_id", "u"]).groupBy("volume_id", "v").agg(F.min("d").alias("d"))
        least = labels.join(near, ["volume_id", "v"], "left").select("volume_id", "v", F.col("c").alias("was"), F.least("c", F.coalesce("d", "c")).alias("p"))
        far = labels.select("volume_id", F.col("v").alias("p"), F.col("c").alias("q"))
        made = _save(least.join(far, ["volume_id", "p"]).select("volume_id", "v", "was", F.least("p", "q").alias("c")), f"{name}-{step}")
        labels = made.select("volume_id", "v", "c")
        if not made.filter("was <> c").limit(1).count():
            break
    number = labels.select("volume_id", "c").distinct().withColumn("label", F.row_number().over(Window.partitionBy("volume_id").orderBy("c")))
    found = voxel.join(labels, ["volume_id", "v"]).join(number, ["volume_id", "c"]).select(*PLACE, "label")
    return mask.join(found, list(PLACE), "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))


def simple_seeds(voxels: DataFrame, h: float) -> DataFrame:
    """Components of the voxels whose value is over h."""
    seeds = components(voxels.withColumn("_v", F.col("value")).withColumn("value", F.when(F.col("value") > h, 1.0).otherwise(0.0)), "seeds")
    return seeds.withColumn("value", F.col("_v")).drop("_v")


def rainfall(voxels: DataFrame, background: float, steps: int = 600) -> DataFrame:
    """Labels that flow down to voxels: each follows the steepest way up in value until it meets a seed.

    voxels: value and label (seeds, 0 elsewhere). Values are turned over, so
    ways go down; those of voxels below background end at once. Pointers are
    followed by doubling: each round sends every voxel to where its target
    points, so ``steps`` single steps take log2(steps) rounds. What meets no
    seed gets 0.
    """
    from .stencil import SINK, neighbours, steepest_descent

    down = steepest_descent(voxels.withColumn("value", 1 - F.col("value")))
    table = F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip(o, AXES)]) for o in neighbours()])
    o = F.get(table, F.col("direction"))
    ends = (F.col("direction") == SINK) | (1 - F.col("_inv") < background) | (F.col("label") > 0)
    both = voxels.select(*PLACE, "label").join(down.withColumnRenamed("value", "_inv"), list(PLACE))
    ways = _save(
        both.select(
            *PLACE,
            F.struct(*[F.when(ends, F.col(a)).otherwise(F.col(a) + o[a]).cast("int").alias(a) for a in AXES]).alias("to"),
            F.col("label").alias("label"),
        ),
        "ways-0",
    )
    k = 0
    while 2**k < steps:
        k += 1
        nxt = ways.select("volume_id", F.struct(*AXES).alias("to"), F.col("to").alias("far"), F.col("label").alias("found"))
        jumped = ways.join(nxt, ["volume_id", "to"]).select(*PLACE, F.col("far").alias("to"), F.when(F.col("label") > 0, F.col("label")).otherwise(F.col("found")).alias("label"), (F.col("far") != F.col("to")).alias("moved"))
        made = _save(jumped, f"ways-{k}")
        ways = made.drop("moved")
        if not made.filter("moved").limit(1).count():
            break
    return voxels.drop("label").join(ways.select(*PLACE, "label"), list(PLACE))
