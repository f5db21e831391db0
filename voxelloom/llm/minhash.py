"""Near-dedup with ProbMinHash: signatures, banding, exact verification, classes.

A text is the set of its five-word shingles. Links are of sets, so all shingles
weigh the same here, however often they occur; ``prob_minhash`` itself takes
weights. Each shingle is a Poisson process whose rate is its weight; its
arrivals, which its hash alone determines, fall on registers at random, and a
register keeps the shingle that arrives there first. Two texts agree in a
register with the probability Jaccard of their weighted sets, which for equal
weights is the Jaccard. A process is stopped when its next arrival is later
than the latest that any register holds.

Bands of registers are hashed to buckets. Texts that meet in a bucket are
verified by the exact Jaccard of their shingle sets; links make classes.

Pairs of a bucket are never written out. All of a bucket is verified against
its first text and classes are formed; a bucket of one class is done. A bucket
that still holds several classes goes to one task as a whole, if it has at most
``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles: intersections of all its sets
are counted there by matrix products, and only links that join classes leave
it. Of a larger one, the parts that share a further band go first, to leave
fewer classes; if it still holds several, all of it is dealt out in blocks,
each against each, but for the largest class against itself. So all similar
pairs of a bucket are linked.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, raw, shield, with_arrow
from .shingles import WIDTH, chunks, counted, mix, shingles

SIMILARITY = 0.8
#: Bands and registers in each: texts of similarity s meet with 1 - (1 - s**6)**32, at 0.8 that is 0.99994.
BANDS, ROWS = 32, 6
#: Texts of a bucket that one task looks at together, and shingles that they have (8 bytes each, and some 50 while they are worked on).
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Times that larger buckets are split by a further band, in the pass before they are looked at whole.
SPLITS = 6
#: Columns of a matrix product.
_COLUMNS = 4096

_GAMMA = np.uint64(0xD1342543DE82EF95)


def prob_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Signatures (texts x registers) of the weighted sets; owner ascends. A text without shingles has zeros."""
    best = np.full(texts * registers, np.inf)
    sign = np.zeros(texts * registers, np.uint64)
    at = np.zeros(len(h))
    step, made = 1, 0
    while len(h):
        points = h[:, None] + np.arange(made + 1, made + step + 1, dtype=np.uint64)[None, :] * _GAMMA
        points = mix(points)
        gaps = -np.log(((points >> np.uint64(24)).astype(np.float64) + 0.5) / float(1 << 40)) / weight[:, None]
        when = at[:, None] + np.cumsum(gaps, axis=1)
        place = ((points & np.uint64((1 << 24) - 1)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64) + (owner * registers)[:, None]
        flat, time = place.ravel(), when.ravel()
        np.minimum.at(best, flat, time)
        won = best[flat] == time
        sign[flat[won]] = np.repeat(h, step)[won]
        at, made = when[:, -1], made + step
        step = made if made > 1 else 1
        last = best.reshape(texts, registers).max(axis=1)
        on = at < last[owner]
        owner, h, weight, at = owner[on], h[on], weight[on], at[on]
    return sign.reshape(texts, registers)


def band_hashes(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), np.uint64)
    for r in range(rows):
        out = mix(out ^ sign[:, r::rows][:, :bands])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64))


def signed_batch(batch: list[bytes], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[list[list[int]], list[int]]:
    """The band hashes of each text, as signed 64-bit integers, none for a text without words; and how many shingles it has."""
    out: list[list[int]] = []
    sizes: list[int] = []
    for run in chunks(batch):
        owner, h, _ = counted(*shingles(run, width))
        keys = band_hashes(prob_minhash(owner, h, np.ones(len(h)), len(run), bands * rows), bands, rows).view(np.int64)
        size = np.bincount(owner, minlength=len(run)).tolist()
        out += [k if n else [] for k, n in zip(keys.tolist(), size)]
        sizes += size
    return out, sizes


def batch_bands(batch: list[bytes], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> list[list[int]]:
    return signed_batch(batch, bands, rows, width)[0]


def shingle_sets(batch: list[bytes], width: int = WIDTH) -> list[list[int]]:
    out: list[list[int]] = []
    for run in chunks(batch):
        owner, h, _ = counted(*shingles(run, width))
        cuts = np.searchsorted(owner, np.arange(1, len(run)))
        out += [x.tolist() for x in np.split(h.view(np.int64), cuts)]
    return out


def _body(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def _tid(docs: DataFrame) -> Column:
    """Names a text: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(_body(docs), 256), 1, 32))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c): the least vertex c of the component of each vertex of edges (a, b)."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    labels = scratch.write(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("d")), "u").groupBy("v").agg(F.min("d").alias("d"))
        least = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "d").alias("p"))
        # The label of the label: labels double their reach.
        jumped = least.join(labels.select(F.col("v").alias("p"), F.col("c").alias("q")), "p", "left").select(
            "v", "was", F.least("p", F.coalesce("q", "p")).alias("c")
        )
        made = scratch.write(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = made.select("v", "c")
        if not made.filter("was <> c").limit(1).count():
            return labels


def linking_pairs(sets: list[np.ndarray], classes: list, p: int, q: int) -> list[tuple[int, int]]:
    """Pairs of sets of Jaccard p / q or more that join classes, as few as it takes."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1  # what one set alone has is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    same = np.zeros((n, n), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + _COLUMNS])
        part = np.zeros((n, _COLUMNS), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        same += part @ part.T
    number = {c: k for k, c in enumerate(dict.fromkeys(classes))}
    own = np.array([number[c] for c in classes])
    near = (p + q) * same.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
    at = np.argwhere(np.triu(near & (own[:, None] != own[None, :]), 1))
    top = list(range(len(number)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, j in at.tolist():
        x, y = find(int(own[i])), find(int(own[j]))
        if x != y:
            top[x] = y
            out.append((i, j))
    return out


def near_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = WIDTH,
    block: int = BLOCK,
    splits: int = SPLITS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(tid, class_tid, class_id, texts): the class of each text that has copies or near copies.

    Texts are near copies when the Jaccard of their sets of ``width``-word
    shingles is at least ``similarity``; a text of fewer words is one shingle,
    a text without words is near to none but its equals. class_id is the least
    doc_id of the class (null if it has none), class_tid the text that holds it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col("doc_id"), _body(docs).alias("text"), _tid(docs).alias("tid"))

    def start():
        def run(text):
            keys, sizes = signed_batch(raw(text), bands, rows, width)
            return [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]

        return run

    signed = with_arrow(source, ["text"], [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("shingles", T.LongType())], start).drop("text")
    one = signed.groupBy("tid").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    one = scratch.write(one, "texts")
    dealt = one.select("tid", "min_id", "shingles", F.posexplode("bands").alias("band", "key"))
    shared = scratch.write(dealt.groupBy("key").agg(F.min("tid").alias("lead"), F.count("*").alias("size")).filter("size > 1"), "shared")
    meet = scratch.write(dealt.join(shared, "key"), "meet")
    scratch.drop("shared")

    # The shingle sets of the texts that meet another; of copies the row with the least doc_id is enough.
    wanted = meet.select("tid", F.col("min_id").alias("wanted_id")).distinct()
    rows_of = source.join(wanted, (source.tid == wanted.tid) & source.doc_id.eqNullSafe(wanted.wanted_id), "left_semi")

    def start_sets():
        return lambda text: [pa.array(shingle_sets(raw(text), width), pa.list_(pa.int64()))]

    sets = scratch.write(
        with_arrow(rows_of.select("tid", "text"), ["text"], [T.StructField("set", T.ArrayType(T.LongType()))], start_sets)
        .drop("text")
        .dropDuplicates(["tid"]),
        "sets",
    )
    ratio = Fraction(str(similarity))
    p, q = ratio.numerator, ratio.denominator

    def verified(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that are similar: |A n B| / |A u B| >= p / q, in integers."""
        a = sets.select(F.col("tid").alias("a"), F.col("set").alias("sa"))
        b = sets.select(F.col("tid").alias("b"), F.col("set").alias("sb"))
        same = F.size(F.array_intersect("sa", "sb")).cast("long")
        return pairs.join(a, "a").join(b, "b").filter((p + q) * same >= p * (F.size("sa") + F.size("sb"))).select("a", "b")

    def pair(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    links = scratch.write(verified(meet.filter("tid <> lead").select(*pair(F.col("lead"), F.col("tid"))).distinct()), "links0")
    classes = components(links, scratch, "classes0")

    def load(texts: Column, shingles: Column) -> Column:
        """How many tasks' worth of texts or shingles that is."""
        return F.greatest(texts / F.lit(float(block)), shingles / F.lit(float(block_shingles)))

    def several(rows_: DataFrame, name: str) -> tuple[DataFrame, float]:
        """The rows of buckets that hold several classes, with the bucket's load; and the largest load."""
        counts = rows_.groupBy("key").agg(load(F.count("*"), F.sum("shingles")).alias("load"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y")
        counts = scratch.write(counts.select("key", "load"), f"{name}-sizes")
        return scratch.write(rows_.join(counts, "key"), name), counts.agg(F.max("load")).first()[0] or 0.0

    def classed(rows_: DataFrame) -> DataFrame:
        """The rows (key, band, tid, shingles) with the class c of the text."""
        return rows_.join(classes.select(F.col("v").alias("tid"), "c"), "tid", "left").select("key", "band", "tid", "shingles", F.coalesce("c", "tid").alias("c"))

    def join_up(table: pa.Table) -> pa.Table:
        tids, named_ = table.column("tid").to_pylist(), table.column("c").to_pylist()
        column = table.column("set").combine_chunks()
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy()
        found = linking_pairs([values[x:y] for x, y in zip(ends[:-1], ends[1:])], named_, p, q) if len(set(named_)) > 1 else []
        return pa.table({"a": pa.array([tids[x] for x, _ in found], pa.binary()), "b": pa.array([tids[y] for _, y in found], pa.binary())})

    def joined(groups: DataFrame) -> DataFrame:
        """The links that join classes within each group (key, i, j) of texts (tid, c)."""
        return groups.join(sets, "tid").groupBy("key", "i", "j").applyInArrow(join_up, "a binary, b binary")

    # The first text of a bucket has met all others of it.
    mixed, most = several(classed(meet.filter("tid <> lead").select("key", "band", "tid", "shingles")), "mixed0")
    at_once = [F.col("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("tid"), F.col("c")]
    if most > 1 and splits:
        # Parts of the large buckets that share further bands, so that fewer classes are left; the buckets stay whole for what follows.
        coarse, largest, parts = mixed.filter("load > 1"), most, []
        while largest > 1 and len(parts) < splits:
            large = coarse.join(one.select("tid", "bands"), "tid")
            further = large.select("key", F.col("band").alias("was"), "tid", "shingles", "c", F.posexplode("bands").alias("band", "other")).filter("band > was")
            finer, largest = several(further.select(F.xxhash64("key", "other").alias("key"), "band", "tid", "shingles", "c"), f"part{len(parts) + 1}")
            parts.append(finer.filter("load <= 1").select(*at_once))
            coarse = finer.filter("load > 1")
        links = scratch.write(joined(reduce(DataFrame.unionByName, parts)).union(links), "links1")
        classes = components(links, scratch, "classes1")
        mixed, most = several(classed(mixed.select("key", "band", "tid", "shingles")), "mixed1")
    if most:
        groups = mixed.filter("load <= 1").select(*at_once)
        if most > 1:
            # Each against each in blocks, but for the largest class of a bucket against itself.
            large = mixed.filter("load > 1").select("key", "tid", "c", "shingles")
            each = large.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
            top = each.groupBy("key").agg(F.max(F.struct("n", "c", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))

            def blocks_of(texts: Column, shingles: Column) -> Column:
                return F.greatest(F.ceil(load(texts, shingles) * 2), F.lit(1)).cast("int")

            apart, inner = blocks_of(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")), blocks_of(F.col("top.n"), F.col("top.s"))
            top = top.select("key", F.col("top.c").alias("main"), apart.alias("apart"), inner.alias("inner"))
            inside, h = F.col("c") == F.col("main"), F.xxhash64("tid")
            own = F.when(inside, F.col("apart") + F.pmod(h, F.col("inner"))).otherwise(F.pmod(h, F.col("apart"))).cast("int")
            facing = F.col("apart") + F.when(inside, 0).otherwise(F.col("inner"))
            placed = large.join(top, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), facing - 1)))
            groups = groups.union(placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "tid", "c"))
        links = scratch.write(joined(groups).union(links), "links2")
        classes = components(links, scratch, "classes2")

    member = one.select("tid", "min_id", "n").join(classes.select(F.col("v").alias("tid"), "c"), "tid", "left")
    member = member.filter("c IS NOT NULL OR n > 1").select("tid", "min_id", "n", F.coalesce("c", "tid").alias("c"))
    heads = scratch.write(
        member.groupBy("c").agg(
            F.min("min_id").alias("class_id"),
            F.min(F.struct(F.col("min_id").isNull(), F.col("min_id"), F.col("tid"))).alias("head"),
            F.sum("n").alias("class_size"),
        ),
        "heads",
    )
    return scratch.write(
        member.join(heads, "c").select("tid", "class_id", F.col("head.tid").alias("class_tid"), F.col("class_size")), "members"
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size and kept of every document.

    class_id is the least doc_id of its class, which a document without copies
    or near copies makes alone; the document with that id is the one kept.
    Null texts count as empty ones, which are copies of one another; null and
    repeated doc_ids are carried along. An empty table gives no rows.
    """
    members = near_classes(docs, **options)
    ids = docs.select("doc_id", _tid(docs).alias("tid"))
    return ids.join(members, "tid", "left").select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("class_size").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the least doc_id, with the columns of docs."""
    members = near_classes(docs, **options).select(F.col("tid").alias("_tid"), F.col("class_tid").alias("_head"), F.col("class_id").alias("_least"))
    safe, back = shield(docs, ["_tid", "_head", "_least"])
    tagged = safe.withColumn("_tid", _tid(safe)).join(members, "_tid", "left")
    alone = F.col("_head").isNull()
    return tagged.filter(alone | ((F.col("_tid") == F.col("_head")) & F.col("doc_id").eqNullSafe(F.col("_least")))).select(*back)
