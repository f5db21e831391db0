"""Volumes and labelings derived from the driver's tables, in Spark and in SQL.

V1: line items counted into an 8 x 16 x 16 grid, value = sum of quantities.
V2: each embedding folded to 4 x 4 x 4.
LD: two labelings of the line items, t and p, 0 being background.
LA: octant-like labels (1 to 8) of the V1 voxels over the mean, 0 elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (8, 16, 16)
FOLD = (4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, shape=SHAPE) -> DataFrame:
    nz, ny, nx = shape
    i = F.col("id")
    return spark.range(nz * ny * nx).select(F.floor(i / (ny * nx)).cast("int").alias("z"), (F.floor(i / nx) % ny).cast("int").alias("y"), (i % nx).cast("int").alias("x"))


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x"))
    sums = cells.agg(F.sum("l_quantity").alias("q"))
    return grid(spark).join(sums, ["z", "y", "x"], "left").select(F.lit("v1").alias("volume_id"), "z", "y", "x", F.coalesce("q", F.lit(0.0)).alias("value"))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("volume_id"), F.posexplode("embedding").alias("i", "value"))
    return rows.select("volume_id", F.floor(i / 16).cast("int").alias("z"), (F.floor(i / 4) % 4).cast("int").alias("y"), (i % 4).cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_partkey") % 9
    p = F.when(F.col("l_orderkey") % 10 < 6 + t % 5, t).otherwise(F.col("l_suppkey") % 9)
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("pair_id"), t.cast("int").alias("t"), p.cast("int").alias("p"))


def la(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, z, y, x, value, label."""
    v = v1(spark, sf_dir)
    total = v.agg(F.sum("value").alias("_t"))  # one row
    octant = 1 + F.floor(F.col("z") / 4) + 2 * F.floor(F.col("y") / 8) + 4 * F.floor(F.col("x") / 8)
    return v.crossJoin(F.broadcast(total)).withColumn("label", F.when(F.col("value") * 2048 > F.col("_t"), octant).otherwise(0).cast("int")).drop("_t")


def sql_grid(shape=SHAPE, name: str = "g") -> str:
    parts = ", ".join(f"(SELECT CAST(unnest(range({n})) AS INTEGER) AS {a})" for a, n in zip("zyx", shape))
    return f"{name} AS (SELECT z, y, x FROM {parts})"


V1_SQL = (
    sql_grid()
    + """, v AS (SELECT 'v1' AS volume_id, z, y, x, coalesce(q, 0.0) AS value FROM g LEFT JOIN (
    SELECT CAST(l_suppkey % 8 AS INTEGER) AS z, CAST(l_partkey % 16 AS INTEGER) AS y, CAST(l_orderkey % 16 AS INTEGER) AS x, sum(l_quantity) AS q
    FROM lineitem GROUP BY ALL) USING (z, y, x))"""
)
V2_SQL = """v AS (SELECT CAST(vec_id AS VARCHAR) AS volume_id, CAST(i // 16 AS INTEGER) AS z, CAST(i // 4 % 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x,
    CAST(e AS DOUBLE) AS value FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings))"""
LD_SQL = """ld AS (SELECT l_linenumber AS pair_id, CAST(l_partkey % 9 AS INTEGER) AS t,
    CAST(CASE WHEN l_orderkey % 10 < 6 + l_partkey % 9 % 5 THEN l_partkey % 9 ELSE l_suppkey % 9 END AS INTEGER) AS p FROM lineitem)"""
LA_SQL = V1_SQL + """, la AS (SELECT *, CAST(CASE WHEN value * 2048 > (SELECT sum(value) FROM v) THEN 1 + z // 4 + 2 * (y // 8) + 4 * (x // 8) ELSE 0 END AS INTEGER) AS label FROM v)"""
