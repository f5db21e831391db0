"""What the training-data operators share: scratch tables and Arrow maps."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; texts are a few KB, so a batch is a few MB.
BATCH_ROWS = 1000
#: Bytes after which Spark ends an Arrow batch of long texts early.
BATCH_BYTES = "16m"
#: Batches after which a worker gives memory back.
TRIM = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own if all runs on one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="voxelloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and they outlive a lost executor.

    Results of an operator read them, so they stay until ``drop`` or ``free``.
    """

    #: Those that have not been dropped, for whoever knows when their tables are not needed any more.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}.parquet"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table that nothing reads any more; with no name, all of them."""
        delete(self.spark, f"{self.root}/{name}.parquet" if name else self.root)
        if not name and self in Scratch.made:
            Scratch.made.remove(self)


def free() -> None:
    """Removes the tables of all operators so far; to be called when their results have been written."""
    for scratch in list(Scratch.made):
        scratch.drop()


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, root: str) -> str:
    """The folder as Arrow's file systems name it, by Hadoop's default file system where it has no scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of an Arrow batch, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """Adds columns that a Python function makes from Arrow columns.

    ``start`` runs once in each task and returns the function; that gets the
    columns named by ``inputs`` and returns an array for each field. A field
    takes the place of an input column of the same name.
    """
    small_batches(df.sparkSession)
    names = df.columns
    at = [names.index(x) for x in inputs]
    new = {f.name.lower() for f in fields}
    keep = [i for i, x in enumerate(names) if x.lower() not in new]
    schema = T.StructType([df.schema.fields[i] for i in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for k, batch in enumerate(batches):
            if batch.num_rows:
                cols = [batch.column(i) for i in keep] + made(*[batch.column(i) for i in at])
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])
                del cols
            if k % TRIM == TRIM - 1:
                give_back()
        give_back()

    return df.mapInArrow(run, schema)


_held: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this process for as long as the same key is asked for: tasks share it, and it goes when another operator needs the room."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty, bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw(column)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:") else os.fspath(path)


def shield(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list]:
    """The frame with its columns of these names renamed, and the columns that give all of them back under their own names."""
    taken, wanted, clash = {c.lower() for c in df.columns}, {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in wanted:
            new = f"_own_{c}"
            while new.lower() in taken or new.lower() in wanted:
                new = f"_own{new}"
            clash[c] = new
            taken.add(new.lower())
    return df.withColumnsRenamed(clash), [F.col(clash[c]).alias(c) if c in clash else F.col(c) for c in df.columns]
