"""Overlap counts of labelings that arrive as a stream.

Counts are additive, so match statistics of everything seen so far come from a
running aggregation in complete mode; nothing is kept but label pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching as M


def running_overlap(stream: DataFrame, pair: tuple[str, ...] = ()) -> DataFrame:
    """Counts (pair, t, p, n) of a stream of rows with labels t and p."""
    return M.overlap(stream, pair)


def start_scores(stream: DataFrame, out: str, checkpoint: str, thresholds=(0.6, 0.7, 0.8, 0.9)) -> StreamingQuery:
    """Rewrites the table of match statistics under ``out`` after each batch; a repeated batch writes the same."""

    def each(counts: DataFrame, _: int) -> None:
        from_counts(counts, thresholds).write.mode("overwrite").parquet(out)

    return running_overlap(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def from_counts(counts: DataFrame, thresholds) -> DataFrame:
    """Statistics by IoU over one half, from counts."""
    from pyspark.sql import functions as F

    scored = M.scores(counts).filter("t <> 0 AND p <> 0")
    sizes = M._counts(counts, ())
    sums = [x for k, t in enumerate(thresholds) for x in (F.sum(F.when(F.col("score") >= t, 1).otherwise(0)).alias(f"tp{k}"), F.sum(F.when(F.col("score") >= t, F.col("score")).otherwise(0.0)).alias(f"s{k}"))]
    return M.statistics(M._unfold(sizes, scored.agg(*sums), list(thresholds), ()))
