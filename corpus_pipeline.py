"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir); what it returns is written
as Parquet and read again as the documents of the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm import decontaminate, exact_dedup, minhash, sampling, toxicity
from voxelloom.llm.common import Scratch, read
from voxelloom.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of the stage before, whose result has been written by the time the next one begins.
_left: list[Scratch] = []


def stage(work: Stage) -> Stage:
    """Frees the scratch tables of the stage before: the documents given are read from what was written of its result."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for old in _left:
            old.drop()
        _left.clear()
        begun = list(Scratch.made)
        out = work(spark, docs, sf_dir)
        _left.extend(x for x in Scratch.made if x not in begun)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are near copies, directly or by way of others, that with the least doc_id stays."""
    return minhash.drop_near_copies(docs)


@stage
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go from the texts; texts that are mostly such passages go."""
    return decontaminate.remove_hits(docs, read(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text with their digests, and sampled segmentations, each with its ids."""
    made = sampling.encode_and_sample(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", *sampling.digests(F.col("ids")), "round_trip", "samples", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the trained score nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
