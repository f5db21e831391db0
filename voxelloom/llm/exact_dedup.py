"""Exact dedup by distributed MSD radix partitioning.

Texts are split by their bytes from the front, a digit of many bytes at a time,
until a group is a single text or its texts have ended; equal texts are those
that end in one group. Nothing is compared by a digest. Digits grow eightfold
from level to level, so the number of levels grows with the logarithm of the
longest text, and the rows of a level are those of groups that the levels
before could not split.

A level counts its groups with partial aggregation, so a group of any size
reaches the reducers as a row for each task, and writes the counts. A second
pass joins them to the rows; both sides are exchanged for it, so AQE can split
a group that holds many of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shield

#: Bytes of the first digit, which alone tells most texts apart.
FIRST = 64
#: Bytes of the digits after it: each GROWTH times the one before, up to LARGEST.
SECOND, GROWTH, LARGEST = 512, 8, 1 << 20


#: Columns that the levels use; input columns of these names are set aside meanwhile.
_OWN = ["_digit", "_n", "_live", "_row", "_text", "_group", "_best", "_next", "_ended"]


def _digit(text: Column, begin: int, width: int) -> Column:
    """Bytes [begin, begin + width) of a binary column; shorter at its end, empty beyond it."""
    return F.substring(text, begin + 1, width)


def exact_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", first: int = FIRST, second: int = SECOND, keep_text: bool = True
) -> DataFrame:
    """Adds keep_id, group_size and kept to every row.

    Texts are equal when their bytes are; null counts as empty. Of equal texts
    the row with the largest key stays, null being the smallest; of rows with
    that key one stays, whichever has the larger internal row number. Columns
    named keep_id, group_size or kept are replaced; others pass through.
    With keep_text=False the text column is left out of the result, and only texts
    that the first digit does not tell apart are written anywhere.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    given = docs.drop("keep_id", "group_size", "kept")
    source, back = shield(given, _OWN)
    text, key = (source.columns[given.columns.index(x)] for x in (text, key))
    names = source.columns if keep_text else [c for c in source.columns if c != text]
    back = [c for c, name in zip(back, source.columns) if name in names]
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))

    shared = scratch.write(
        source.select(_digit(body, 0, first).alias("_digit")).groupBy("_digit").agg(F.count("*").alias("_n")).filter("_n > 1").select("_digit"),
        "first",
    )
    split = source.withColumn("_digit", _digit(body, 0, first)).join(
        shared.withColumn("_live", F.lit(True)).hint("shuffle_hash"), "_digit", "left"
    )
    single = F.col("_live").isNull()
    split = split.select(
        *names,
        F.monotonically_increasing_id().alias("_row"),
        F.when(single, F.lit(None)).otherwise(body).alias("_text"),
    )
    # The rows that stay whole are written once, with their row numbers: a lost executor can't renumber them.
    base = scratch.write(split, "rows")
    scratch.drop("first")

    done = [
        base.filter("_text IS NULL").select(
            *names, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
        )
    ]
    live = base.filter("_text IS NOT NULL").select(*names, "_row", "_text", F.lit(0).cast("long").alias("_group"))
    at, width, level, last = 0, second, 0, None
    while live is not None:
        group = ["_group", "_digit"]
        rows = live.withColumn("_digit", _digit(F.col("_text"), at, width))
        counts = scratch.write(
            rows.groupBy(*group).agg(
                F.count("*").alias("_n"),
                F.max(F.struct(F.col(key).alias("k"), F.col("_row").alias("r"))).alias("_best"),
                F.max("_row").alias("_next"),
            ),
            f"counts{level}",
        )
        joined = rows.join(counts, group).drop("_digit", "_group").withColumnRenamed("_next", "_group")
        ended = (F.col("_n") == 1) | (F.length("_text") < at + width)
        out = scratch.write(
            joined.withColumn("_ended", ended).withColumn("_text", F.when(ended, F.lit(None)).otherwise(F.col("_text"))),
            f"level{level}",
        )
        done.append(
            out.filter("_ended").select(
                *names,
                F.col("_best.k").alias("keep_id"),
                F.col("_n").alias("group_size"),
                (F.col("_best.r") == F.col("_row")).alias("kept"),
            )
        )
        scratch.drop(f"counts{level}")
        left = out.filter("NOT _ended").select(*names, "_row", "_text", "_group")
        at, width, level = at + width, min(width * GROWTH, LARGEST), level + 1
        live = left if left.limit(1).count() else None
    return reduce(DataFrame.unionByName, done).select(*back, "keep_id", "group_size", "kept")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; the digest is an output, not a key."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select("doc_id", "text", F.unhex(F.sha2(body, 256)).alias("_sha"))
    groups = exact_groups(narrow, keep_text=False)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, with the columns of docs."""
    safe, back = shield(docs, ["keep_id", "group_size", "kept"])
    return exact_groups(safe).filter("kept").select(*back)
