"""Folders of volumes: listing, pairing, reading to voxels, and writing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .arrays import read_array, write_npy, write_tiff


def qualified(spark: SparkSession, root: str) -> str:
    """The folder as Arrow's file systems name it, by Hadoop's default file system where it has no scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write_text(spark: SparkSession, root: str, name: str, lines: Sequence[str]) -> None:
    """A small text file of a line each."""
    fs, where = pafs.FileSystem.from_uri(qualified(spark, root))
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/{name}") as f:
        f.write("".join(f"{x}\n" for x in lines).encode())


def listing(spark: SparkSession, path: str, suffixes: Sequence[str] = (".tif", ".npy")) -> DataFrame:
    """(name, stem, number, role, path, length) of the files of a folder; contents are not read."""
    glob = "*{" + ",".join(suffixes) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    return named(found.withColumn("name", F.element_at(F.split("path", "/"), -1)))


def named(files: DataFrame) -> DataFrame:
    """Adds stem, number and role to rows that have a name."""
    return files.withColumns({"stem": F.regexp_replace("name", r"\.[^.]*$", ""), "number": S.first_number(F.col("name")), "role": S.role_of(F.col("name"))})


def split_by_word(files: DataFrame, word: str = "img") -> tuple[DataFrame, DataFrame]:
    """Images (the name contains the word) and labels (it does not), each with its rank by name."""
    rank = F.row_number().over(Window.orderBy("name"))  # names of one folder
    images, labels = files.filter(F.col("name").contains(word)), files.filter(~F.col("name").contains(word))
    return images.withColumn("rank", rank), labels.withColumn("rank", rank)


def pair_by_position(images: DataFrame, labels: DataFrame, same_number: bool = False) -> DataFrame:
    """(rank, image, label): files of equal rank; with same_number only those whose first numbers agree."""
    both = images.select("rank", F.col("name").alias("image"), F.col("number").alias("_a")).join(labels.select("rank", F.col("name").alias("label"), F.col("number").alias("_b")), "rank")
    return (both.filter("_a = _b") if same_number else both).drop("_a", "_b")


def pair_by_number(files: DataFrame) -> DataFrame:
    """(number, image, label, integer): images with the label of their number, and the first integer label of it or null."""
    first = lambda role: files.filter(F.col("role") == role).groupBy("number").agg(F.min("name").alias(role))
    images = files.filter("role = 'image'").select("number", F.col("name").alias("image"))
    labels = files.filter("role = 'label'").select("number", F.col("name").alias("label"))
    return images.join(labels, "number").join(first("integer"), "number", "left")


def require_pairs(files: DataFrame) -> DataFrame:
    """The pairs; raises ValueError where a role has no file, or images and labels differ in number."""
    n = {r.role: r["count"] for r in files.groupBy("role").count().collect()}  # at most four rows
    missing = [r for r in ("image", "label") if not n.get(r)]
    if missing or n["image"] != n["label"]:
        raise ValueError(f"no {' and no '.join(missing)}" if missing else f"{n['image']} images but {n['label']} labels")
    return pair_by_number(files)


def factors(texts: DataFrame) -> DataFrame:
    """Factors of resizing texts (column text), rounded half to even to two decimals."""
    return texts.withColumn("factors", F.transform(S.float_list(F.col("text")), lambda x: F.bround(x, 2)))


def read_voxels(spark: SparkSession, path: str, suffixes: Sequence[str] = (".tif", ".npy"), truncate: bool = False) -> DataFrame:
    """The voxels of all volumes of a folder; volume_id is the file's stem. A 2-D file is one layer.

    truncate: values cut to whole numbers, as integer labels need them.
    """
    glob = "*{" + ",".join(suffixes) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                a = read_array(name, bytes(content))
                a = a[None] if a.ndim == 2 else a
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                plane = np.indices(a.shape[1:]).reshape(2, -1)
                for z in range(len(a)):  # a layer at a time
                    v = a[z].ravel().astype(float)
                    yield pd.DataFrame({"volume_id": stem, "z": z, "y": plane[0], "x": plane[1], "value": np.trunc(v) if truncate else v})

    return found.mapInPandas(run, "volume_id string, z int, y int, x int, value double")


def write_volumes(voxels: DataFrame, root: str, column: str = "value", suffix: str = ".npy", dtype: str = "float32", ending: str = "") -> DataFrame:
    """Writes a file for each volume under root (a folder that both Hadoop's and Arrow's file systems know): (volume_id, file, n_instances).

    A file's name is that of its volume and ``ending``. n_instances is the
    number of distinct values besides 0. Files get their names once whole, so a
    repeated task leaves no half file; what was written is kept as a table.
    """
    from ..operators.labels import shared_folder

    spark = voxels.sparkSession
    root = qualified(spark, root)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        fs, where = pafs.FileSystem.from_uri(root)
        fs.create_dir(where, recursive=True)
        at = frame[["z", "y", "x"]].to_numpy()
        a = np.zeros(at.max(0) + 1, dtype)
        a[tuple(at.T)] = frame[column]
        name = f"{where}/{frame.volume_id.iloc[0]}{ending}{suffix}"
        mark = f"{name}.{np.random.default_rng().integers(1 << 60)}"
        with fs.open_output_stream(mark) as f:
            f.write(write_tiff(a) if suffix == ".tif" else write_npy(a))
        fs.move(mark, name)
        return pd.DataFrame({"volume_id": [frame.volume_id.iloc[0]], "file": [name], "n_instances": [int(len(np.unique(a[a != 0])))]})

    schema = "volume_id string, file string, n_instances long"
    table = shared_folder(spark, "written") + ".parquet"
    voxels.select("volume_id", "z", "y", "x", column).groupBy("volume_id").applyInPandas(one, schema).write.parquet(table)
    return spark.read.schema(schema).parquet(table)


def write_predicted(labels: DataFrame, root: str, when: str | None = None) -> DataFrame:
    """Predicted labels as {volume}_labels_predicted_{time}.tif under preds, with the count of instances; ``when`` is now by default."""
    spark = labels.sparkSession
    when = when or spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd_HH-mm-ss")).first()[0]
    return write_volumes(labels, f"{root.rstrip('/')}/preds", "label", ".tif", ending=f"_labels_predicted_{when}")


def write_steps(root: str, preprocessed: DataFrame | None = None, heat: DataFrame | None = None) -> list[DataFrame]:
    """What inference reads and gives, before any label: {volume}_input_image_preprocessed.tif and {volume}_inference_output.tif under preds."""
    parts = [(preprocessed, "_input_image_preprocessed"), (heat, "_inference_output")]
    return [write_volumes(v, f"{root.rstrip('/')}/preds", "value", ".tif", ending=name) for v, name in parts if v is not None]


def write_factors(spark: SparkSession, root: str, values: Sequence[float]) -> None:
    """Resizing factors as a list in resizing_factors.txt."""
    write_text(spark, root, "resizing_factors.txt", [str([float(v) for v in values])])


def write_losses(losses: DataFrame, root: str) -> None:
    """(step, part, loss) as a line each in train_losses.txt and val_losses.txt, in the order of steps."""
    for part in ("train", "val"):
        rows = losses.filter(F.col("part") == part).orderBy("step").select("loss").toLocalIterator()  # a row for each evaluation of one run
        write_text(losses.sparkSession, root, f"{part}_losses.txt", [str(r.loss) for r in rows])


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """(factors) of the first file, by name, that says so in its name; no row where there is none."""
    found = spark.read.format("binaryFile").load(path).filter(F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit("resizing_factors")))
    first = found.orderBy("path").limit(1).select(F.element_at(F.split(F.decode("content", "UTF-8"), "\n"), 1).alias("text"))
    return factors(first).select("factors")


def training_files(files: DataFrame, image_format: str = ".tif", label_format: str = ".npy") -> DataFrame:
    """(number, image, label, integer): images and heat labels paired by their place in the order of numbers, those of unlike numbers dropped, and the first integer label of that number or null.

    files: name, number and role, as ``named`` gives them. Images and labels
    are those of the given formats; only files with a number count.
    """
    numbered = files.filter(F.col("number") >= 0)
    ranked = lambda role, end: numbered.filter((F.col("role") == role) & F.col("name").endswith(end)).withColumn("rank", F.row_number().over(Window.orderBy("number", "name")))  # noqa: E731  # names of one folder
    images = ranked("image", image_format).select("rank", "number", F.col("name").alias("image"))
    labels = ranked("label", label_format).select("rank", F.col("number").alias("_n"), F.col("name").alias("label"))
    first = numbered.filter("role = 'integer'").groupBy("number").agg(F.min("name").alias("integer"))
    return images.join(labels, "rank").filter("number = _n").select("number", "image", "label").join(first, "number", "left")


def read_training(spark: SparkSession, path: str, image_format: str = ".tif", label_format: str = ".npy", label_to_int: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The training volumes of a folder: voxels (number, z, y, x, image, heat, integer), the pairs of files, and the resizing factors.

    Heat labels are cut to whole numbers if label_to_int says so; integer
    labels always are, and null where a volume has none. Raises ValueError
    where the folder has no image, no heat label or no integer label.
    """
    listed = listing(spark, path)
    roles = {r.role for r in listed.select("role").distinct().collect()}  # at most four
    missing = [r for r in ("image", "label", "integer") if r not in roles]
    if missing:
        raise ValueError(f"no {' and no '.join(missing)} files in {path}")
    pairs = training_files(listed, image_format, label_format)
    voxels = read_voxels(spark, path)
    out = None
    for role, value in (("image", "image"), ("label", "heat"), ("integer", "integer")):
        stems = pairs.select("number", F.regexp_replace(role, r"\.[^.]*$", "").alias("volume_id")).dropna()
        v = F.col("value")
        v = v.cast("long").cast("int") if role == "integer" else F.signum(v) * F.floor(F.abs(v)) if role == "label" and label_to_int else v
        part = voxels.join(F.broadcast(stems), "volume_id").select("number", "z", "y", "x", v.alias(value))  # names of one folder
        out = part if out is None else out.join(part, ["number", "z", "y", "x"], "left" if role == "integer" else "inner")
    return out, pairs, read_factors(spark, path)


def read_both(spark: SparkSession, normal: str, upsampled: str, **options) -> tuple[DataFrame, DataFrame]:
    """The training voxels of two folders, as they are and upsampled."""
    return read_training(spark, normal, **options)[0], read_training(spark, upsampled, **options)[0]


def write_training(image: DataFrame, heat: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """The three files of each training volume: {n}img, {n}heat_mask, {n}integer."""
    parts = [(image, "value", "img"), (heat, "heat", "heat_mask"), (labels, "label", "integer")]
    out = None
    for frame, column, name in parts:
        got = write_volumes(frame.withColumn("volume_id", F.concat("volume_id", F.lit(name))), root, column, ".tif")
        out = got if out is None else out.unionByName(got)
    return out


def to_blocks(voxels: DataFrame, side: int = 64) -> DataFrame:
    """Blocked form: a row for each block, its voxels as little-endian doubles, z slowest."""
    keyed = voxels.withColumns({f"_{a}": (F.floor(F.col(a) / side) * side).cast("int") for a in "zyx"})

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        origin = [int(frame[f"_{a}"].iloc[0]) for a in "zyx"]
        at = frame[list("zyx")].to_numpy() - origin
        shape = at.max(0) + 1
        a = np.zeros(shape, "<f8")
        a[tuple(at.T)] = frame["value"]
        return pd.DataFrame({"volume_id": [frame.volume_id.iloc[0]], "origin": [dict(zip("zyx", origin))], "shape": [dict(zip("zyx", map(int, shape)))], "dtype": ["<f8"], "data": [a.tobytes()]})

    from ..model import BLOCKS

    return keyed.groupBy("volume_id", "_z", "_y", "_x").applyInPandas(one, BLOCKS)


def from_blocks(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                shape = [r.shape[a] for a in "zyx"]
                at = np.indices(shape).reshape(3, -1)
                yield pd.DataFrame({"volume_id": r.volume_id, **{a: at[k] + r.origin[a] for k, a in enumerate("zyx")}, "value": np.frombuffer(r.data, r.dtype)})

    return blocks.mapInPandas(run, "volume_id string, z int, y int, x int, value double")
