"""Token ids as length-delimited binary records, with offset indexes.

A shard file is a run of records, each framed as

    length (8 bytes, little-endian), masked CRC-32C of those 8 bytes (4),
    payload, masked CRC-32C of the payload (4)

which is the framing of TFRecord files. A payload is a byte that is 0 for a
null doc_id and else 1, the 8 bytes of doc_id (little-endian, signed) and then
the ids, little-endian, of 2 bytes each where the vocabulary has at most 65,536
ids and else of 4. Beside each shard lies an index with the offset of each
record (8 bytes each), so that a reader can fetch records in any order without
a scan. A manifest, a table with a row for each shard, says in which order
shards follow one another and how many records and ids each has.

Documents are dealt out by ranges of doc_id, sorted, and encoded where they
are written, so that texts are shuffled once and ids never.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, doc_texts, give_back, qualified, resident, small_batches, texts, with_arrow
from .kept import Kept, code_points, runs

#: Documents that one task writes, about (fewer where there would be less tasks than cores), and bytes after which it begins another shard.
TASK_DOCS = 32_000
SHARD_BYTES = 64 << 20
#: Characters worked on at once (a longer text alone), and letters of the strings whose ids a worker keeps, some 15 bytes each with all that goes with them.
CHARS = 500_000
KEPT_LETTERS = 4_000_000
#: New strings that go to the tokenizer together.
TOGETHER = 512
#: What the pieces that end a word have behind them.
WORD_END = "</w>"
END_ID = 2


# ---- framing

_POLY = 0x82F63B78  # Castagnoli, reflected
_MASK = 0xA282EAD8


#: Bytes of a segment: all segments of all payloads advance together, and are then put together payload by payload.
_SEGMENT = 512


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables to take eight bytes at a time, and to advance a register by a segment of zeros."""
    t = np.zeros((8, 256), np.uint32)
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(_POLY), row >> 1).astype(np.uint32)
    t[0] = row
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & 0xFF] ^ (t[k - 1] >> 8)
    ahead = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_SEGMENT):
        ahead = t[0][ahead & 0xFF] ^ (ahead >> 8)
    return t, ahead


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload.

    The start value 0xFFFFFFFF is the same as turning the first four bytes
    over, and with a start value of 0 zeros in front change nothing; so each
    payload is filled up in front to whole segments.
    """
    t, ahead = _tables()
    n = len(payloads)
    lengths = np.fromiter(map(len, payloads), np.int64, n)
    short = np.flatnonzero(lengths < 4)
    segments = np.maximum(-(-lengths // _SEGMENT), 1)
    ends = np.cumsum(segments) * _SEGMENT
    data = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    for p, size, end in zip(payloads, lengths.tolist(), ends.tolist()):
        data[end - size : end] = np.frombuffer(p, np.uint8)
    for k in range(4):
        data[(ends - lengths)[lengths >= 4] + k] ^= 0xFF
    table = data.reshape(-1, _SEGMENT)
    crc = np.zeros(len(table), np.uint32)
    words = table.view("<u4")
    for w in range(0, _SEGMENT // 4, 2):
        low, high = crc ^ words[:, w], words[:, w + 1]
        crc = t[7][low & 0xFF] ^ t[6][low >> 8 & 0xFF] ^ t[5][low >> 16 & 0xFF] ^ t[4][low >> 24] ^ t[3][high & 0xFF] ^ t[2][high >> 8 & 0xFF] ^ t[1][high >> 16 & 0xFF] ^ t[0][high >> 24]
    first = np.cumsum(segments) - segments
    order = np.argsort(-segments, kind="stable")
    out = np.zeros(n, np.uint32)
    many = segments[order]
    for k in range(int(many[0]) if n else 0):
        on = order[: int(np.searchsorted(-many, -k, "left"))]
        r = out[on]
        out[on] = ahead[0][r & 0xFF] ^ ahead[1][r >> 8 & 0xFF] ^ ahead[2][r >> 16 & 0xFF] ^ ahead[3][r >> 24] ^ crc[first[on] + k]
    for i in short.tolist():
        r = 0xFFFFFFFF
        for byte in payloads[i]:
            r = int(t[0][(r ^ byte) & 0xFF]) ^ r >> 8
        out[i] = r
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15 | crc << 17) + np.uint32(_MASK)).astype(np.uint32)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    return [h + int(x).to_bytes(4, "little") + p + int(y).to_bytes(4, "little") for h, x, p, y in zip(heads, a, payloads, b)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of whole records; raises ValueError where a checksum is wrong."""
    heads = [r[:8] for r in records]
    payloads = [r[12:-4] for r in records]
    a, b = masked(crc32c(heads)), masked(crc32c(payloads))
    for r, h, x, p, y in zip(records, heads, a, payloads, b):
        if int.from_bytes(h, "little") != len(p) or r[8:12] != int(x).to_bytes(4, "little") or r[-4:] != int(y).to_bytes(4, "little"):
            raise ValueError("corrupt record")
    return payloads


# ---- encoding


# Kinds of letters. The tokenizer's pattern never takes a letter and a sign or digit behind it together, and no rule of
# normalisation joins a sign or digit of ASCII to what is in front of it; so a text may be cut between a letter that is one
# before and after normalisation, as those of ASCII and Latin-1 and the two blocks behind it are, and such a sign.
_SPACE, _LETTER, _SIGN, _OTHER = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    kind = np.full(0x250, _LETTER, np.uint8)
    kind[:0xC0] = _OTHER
    for c in range(0x80):
        kind[c] = _LETTER if chr(c).isalpha() else _SIGN if 0x20 < c < 0x7F else _OTHER
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[[0xD7, 0xF7, 0x130]] = _OTHER  # two signs, and the one letter here that becomes a letter and a mark
    return kind


#: Strings that are one word to the tokenizer: letters, or signs without an apostrophe.
_ONE_WORD = re.compile(r"[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")


def cut_points(letters: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that are encoded on their own begin, and their sizes; white space is left out.

    ``whole`` says of each letter whether no cut but at white space may be made in front of it. Texts must be parted by white space.
    """
    kind = np.full(len(letters), _OTHER, np.uint8)
    known = letters < 0x250
    kind[known] = _kinds()[letters[known]]
    solid = kind != _SPACE
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | ((kind[:-1] == _LETTER) & (kind[1:] == _SIGN) & ~whole[1:])
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(letters))
    # A string ends at white space, if there is some before the next one begins.
    gaps = np.flatnonzero(~solid & np.append(True, solid[:-1]))
    at = np.searchsorted(gaps, starts)
    stop = np.append(gaps, len(letters))[at]
    return starts, np.minimum(ends, stop) - starts


def lowered(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The letters with A-Z lowered in strings that have nothing but ASCII and no "|", as the tokenizer does it; elsewhere marks might follow."""
    upper = (letters >= 65) & (letters <= 90)
    if not upper.any() or not len(starts):
        return letters
    own = letters[runs(starts, sizes)]
    plain = np.logical_and.reduceat((own < 0x80) & (own != 0x7C), np.cumsum(sizes) - sizes)
    may = np.zeros(len(letters), bool)
    may[runs(starts[plain], sizes[plain])] = True
    return np.where(upper & may, letters + np.uint32(32), letters)


class TextEncoder:
    """Encodes texts string by string: what stands between white space, cut behind letters.

    The tokenizer drops white space and no token spans it or a cut, so a text's
    ids are its strings' ids in order. Strings recur; the ids of those that do
    are kept, within a bound.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of pieces that end a word
        self.ends[[i for x, i in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = Kept(self._encode, KEPT_LETTERS, self.dtype)

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many strings in few calls, joined by spaces. Where each is one word of the tokenizer's, the ends of words say whose ids are whose; else the tokens' places do."""
        one = [bool(_ONE_WORD.fullmatch(x)) for x in strings]
        order = np.argsort(np.logical_not(one), kind="stable")
        many = sum(one)
        groups = [order[k : min(many, k + TOGETHER)] for k in range(0, many, TOGETHER)] + [order[k : k + TOGETHER] for k in range(many, len(strings), TOGETHER)]
        found = [self._group([strings[i] for i in g.tolist()], one[g[0]]) for g in groups]
        ids, sizes = (np.concatenate(x) for x in zip(*found))
        back = np.argsort(order)
        begin = np.cumsum(sizes) - sizes
        return ids[runs(begin[back], sizes[back])], sizes[back]

    def _group(self, group: list[str], one: bool) -> tuple[np.ndarray, np.ndarray]:
        text = " ".join(group)
        if one:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(group):
                return ids, np.diff(ends, prepend=-1)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        stops = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
        begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        return np.array(e.ids, self.dtype), np.diff(np.searchsorted(begins, stops), prepend=0)

    def _some(self, batch: list[str], last: np.ndarray) -> list[bytes]:
        letters = code_points([t + "\n" for t in batch])
        whole = np.zeros(len(letters), bool)
        if any("<" in t and any(x in t for x in self.special) for t in batch):
            whole[:] = True  # the names of special tokens are taken as such, letters, signs and all
        starts, sizes = cut_points(letters, whole)
        letters = lowered(letters, starts, sizes)
        text_ends = np.cumsum(np.fromiter(map(len, batch), np.int64, len(batch)) + 1)
        ids, cut = self.kept.encoded(self.kept(letters, starts, sizes), np.searchsorted(starts, text_ends))
        data, places = ids.tobytes(), (cut * self.dtype.itemsize).tolist()
        end = last.tobytes()
        return [data[a:b] + end for a, b in zip(places[:-1], places[1:])]

    def __call__(self, batch: list[str], end_id: int | None = None) -> list[bytes]:
        """The ids of each text, little-endian, with end_id behind them."""
        last = np.array([] if end_id is None else [end_id], self.dtype)
        out: list[bytes] = []
        at = 0
        while at < len(batch):
            to, held = at, 0
            while to < len(batch) and (to == at or held + len(batch[to]) <= CHARS):
                held += len(batch[to])
                to += 1
            out += self._some(batch[at:to], last)
            at = to
        return out


def encoder(path: str) -> TextEncoder:
    """That of this process, so that a worker's tasks share what it keeps."""
    return resident(("encoder", path), lambda: TextEncoder(path))


# ---- files


def _fs(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def shard_name(part: int, turn: int) -> str:
    return f"shard-{part:06d}-{turn:04d}"


class ShardWriter:
    """Writes a shard and its index under other names and renames them at the end, so a lost or repeated task leaves whole files."""

    def __init__(self, root: str, part: int, turn: int):
        self.fs, self.dir = _fs(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.part, self.turn, self.own = part, turn, f"{self.dir}/_{part}-{turn}-{os.getpid()}-{os.urandom(4).hex()}"
        self.out = self.fs.open_output_stream(self.own)
        self.offsets: list[int] = []
        self.at = self.ids = 0

    def add(self, payloads: list[bytes], size: int) -> None:
        for r in frame(payloads):
            self.offsets.append(self.at)
            self.at += len(r)
            self.out.write(r)
        self.ids += sum((len(p) - HEAD) // size for p in payloads)

    def close(self) -> tuple[int, int, int, int]:
        self.out.close()
        with self.fs.open_output_stream(f"{self.own}.idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        where = f"{self.dir}/{shard_name(self.part, self.turn)}"
        self.fs.move(f"{self.own}.idx", f"{where}.idx")
        self.fs.move(self.own, f"{where}.rec")
        return self.part, self.turn, len(self.offsets), self.ids


#: Bytes of a payload in front of the ids.
HEAD = 9


def payload(doc_id: int | None, ids: bytes) -> bytes:
    return (b"\0" if doc_id is None else b"\1") + (doc_id or 0).to_bytes(8, "little", signed=True) + ids


def doc_id_of(payload: bytes) -> int | None:
    return int.from_bytes(payload[1:HEAD], "little", signed=True) if payload[0] else None


def read_records(root: str, part: int, turn: int, which: list[int]) -> list[bytes]:
    """Payloads of some records of a shard, in the order asked for, by way of the index."""
    fs, where = _fs(root)
    with fs.open_input_file(f"{where}/{shard_name(part, turn)}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8")
    with fs.open_input_file(f"{where}/{shard_name(part, turn)}.rec") as f:
        ends = np.append(offsets[1:], f.size())
        return unframe([f.read_at(int(ends[i] - offsets[i]), int(offsets[i])) for i in which])


def scan_shard(root: str, part: int, turn: int, batch: int = 500, most: int = 16 << 20) -> Iterator[list[bytes]]:
    """All payloads of a shard in order, in lists of bounded size."""
    fs, where = _fs(root)
    with fs.open_input_stream(f"{where}/{shard_name(part, turn)}.rec") as f:
        records: list[bytes] = []
        held = 0
        while head := f.read(12):
            records.append(head + f.read(int.from_bytes(head[:8], "little") + 4))
            held += len(records[-1])
            if len(records) >= batch or held >= most:
                yield unframe(records)
                records, held = [], 0
        if records:
            yield unframe(records)


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Adds ids: the text's ids and end_id as little-endian bytes. Null counts as empty: end_id alone."""

    def start():
        encode_texts = encoder(path)
        return lambda text: [pa.array(encode_texts(texts(text), end_id), pa.binary())]

    return with_arrow(docs, ["text"], [T.StructField("ids", T.BinaryType())], start)


def width(path: str) -> int:
    return encoder(path).dtype.itemsize


def dealt(rows: DataFrame, value: str, task_docs: int = TASK_DOCS) -> DataFrame:
    """doc_id and value, in partitions that are ranges of doc_id (null first), each sorted.

    Rows of one doc_id are sorted by a hash of the value. They may be many, and
    equal as well, so ranges are also by that hash and by a number that the rows have.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // task_docs), min(4 * cores, n // 500))
    marked = rows.select("doc_id", value, F.xxhash64(value).alias("_hash"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("_spread"))
    order = ["doc_id", "_hash", "_spread"]
    return marked.repartitionByRange(tasks, *order).sortWithinPartitions("doc_id", "_hash", value).select("doc_id", value)


def write_shards(rows: DataFrame, value: str, root: str, size: int, start: Callable[[], Callable[[pa.Array], list[bytes]]], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the rows of each partition in their order, as shards; the manifest: part, turn, records, ids, and base, the ids of all shards before.

    ``start`` runs once in each task and returns what makes ids, of ``size``
    bytes each, from the column ``value``. A partition without rows has no shard.
    """
    spark = rows.sparkSession
    small_batches(spark)
    root = qualified(spark, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, writer, done = start(), None, []
        part = TaskContext.get().partitionId()
        for b in batches:
            payloads = [payload(x, y) for x, y in zip(b.column(0).to_pylist(), ids_of(b.column(1)))]
            if payloads:
                writer = writer or ShardWriter(root, part, len(done))
                writer.add(payloads, size)
                if writer.at >= shard_bytes:
                    done.append(writer.close())
                    writer = None
                    give_back()
        if writer:
            done.append(writer.close())
        give_back()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done)], ["part", "turn", "records", "ids"])

    made = Scratch(spark, "manifest").write(rows.select("doc_id", value).mapInArrow(write, "part long, turn long, records long, ids long"), "shards")
    order = Window.orderBy("part", "turn")  # a row for each shard
    before = F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.select("*", before.alias("base"), (F.row_number().over(order) - 1).alias("shard"))


def read_back(spark: SparkSession, manifest: DataFrame, root: str, size: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files."""
    root = qualified(spark, root)
    plan = manifest.select("part", "turn", "base", "shard").repartitionById(max(1, manifest.count()), F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, turn, start in zip(*[b.column(k).to_pylist() for k in range(3)]):
                for payloads in scan_shard(root, part, turn):
                    ids = [np.frombuffer(p, f"<u{size}", offset=HEAD) for p in payloads]
                    n = np.fromiter(map(len, ids), np.int64, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc_id_of(p) for p in payloads], pa.int64()),
                            pa.array(start + np.cumsum(n) - n),
                            pa.array(n),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(n.sum())

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_texts(docs: DataFrame, path: str, root: str, end_id: int = END_ID, task_docs: int = TASK_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes documents and writes them as record shards under root, in order of doc_id (ties: by a hash of the text); the manifest."""

    def start():
        encode_texts = encoder(path)
        return lambda text: encode_texts(texts(text), end_id)

    return write_shards(dealt(doc_texts(docs), "text", task_docs), "text", root, width(path), start, shard_bytes)


def round_trip(docs: DataFrame, path: str, root: str | None = None, end_id: int = END_ID, task_docs: int = TASK_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes documents, writes them as record shards under root, and reads the files back.

    Every row gives a record, repeated rows too; null and empty texts give a
    record of the end id alone; rows without doc_id come first; columns
    besides doc_id and text are not read. An empty table gives no shard and no rows. root defaults to a
    folder in the shared checkpoint folder; it may be any folder that both
    Hadoop's and Arrow's file systems know.
    """
    spark = docs.sparkSession
    root = root or f"{Scratch(spark, 'records').root}/shards"
    return read_back(spark, write_texts(docs, path, root, end_id, task_docs, shard_bytes), root, width(path))
