"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record becomes a ``metadata`` record (JSON: the source's headers in
their order, repeated ones too, the HTTP status and headers, title, links,
lengths) and a ``conversion`` record (the page's text). Both refer to the
response by WARC-Refers-To, keep its target URI and date, and carry digests of
their own blocks; record ids are derived from the response's id, so a repeated
task makes the same records. A record that can not be read gives none, and a
text that says why.

Metadata records are written to .wat.gz and conversion records to .wet.gz
files, each a gzip member, with an index of their places.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, qualified, small_batches, texts, with_arrow
from .html import Seen, plain_text

Headers = list[tuple[str, str]]

VERSION = "WARC/1.1"
#: The date that captures get which come without one.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, RFC 4122
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([a-zA-Z0-9_:.-]+)", re.I)
#: Bytes of a page in which it may name its charset.
META_BYTES = 1024


#: All pairs of digits in base 32 (RFC 4648), ten bits each.
_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it: SHA-1 in base 32."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([None if x is None else str(x) for x in names]))}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n\x00]+", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record; Content-Length and the two line ends after the block are added."""
    lines = [VERSION, *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def value_of(headers: Headers, name: str, default: str | None = None) -> str | None:
    """The first value of a name, whatever its case."""
    name = name.lower()
    return next((v for k, v in headers if k.lower() == name), default)


def fields_of(lines: list[str]) -> Headers:
    """Header lines as pairs in their order; a line that begins with white space goes on the one before."""
    out: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a run of records. Raises ValueError where one is malformed or cut short."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("no end of headers")
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        headers = fields_of(lines)
        length = value_of(headers, "Content-Length", "")
        if not length.isdecimal():
            raise ValueError("no Content-Length")
        begin, size = end + 4, int(length)
        if data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError("cut short")
        yield headers, data[begin : begin + size]
        at = begin + size + 4


def response(page_id: object, url: str | None, html: bytes, date: str = DATE) -> bytes:
    """A response record of a page, for stores that keep only the page itself."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id, url, date)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(html)), ("WARC-Block-Digest", digest(block))]
    return build(headers, block)


def http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response; one without a header end is all payload."""
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end:
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, fields_of(lines), payload


def body_of(fields: Headers, payload: bytes) -> bytes:
    """The payload without its codings, gzip and deflate; as it is where they do not hold."""
    for coding in reversed((value_of(fields, "Content-Encoding", "") or "").lower().split(",")):
        if coding.strip() in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompressobj(47).decompress(payload)
            except zlib.error:
                break
    return payload


def text_of(fields: Headers, body: bytes) -> str:
    """The page by its charset: that of Content-Type, of a byte order mark, of the page's meta element, else UTF-8; what that can not read becomes U+FFFD."""
    named = _CHARSET.search(value_of(fields, "Content-Type", "") or "")
    meta = _META.search(body[:META_BYTES])
    for name in ("utf-8-sig" if body.startswith(codecs.BOM_UTF8) else "", named[1] if named else "", meta[1].decode() if meta else ""):
        try:
            if name:
                return body.decode(codecs.lookup(name).name, "replace")
        except (LookupError, ValueError):  # not the name of a charset
            continue
    return body.decode("utf-8", "replace")


def derive(record: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response record. Raises ValueError if it is not one, or has no id or date."""
    found = next(parse(record), None)
    if found is None:
        raise ValueError("empty")
    headers, block = found
    source, date, target = (value_of(headers, f"WARC-{x}") for x in ("Record-ID", "Date", "Target-URI"))
    if (value_of(headers, "WARC-Type") or "").lower() != "response":
        raise ValueError("not a response")
    if not source or not date:
        raise ValueError("no WARC-Record-ID" if not source else "no WARC-Date")
    status, fields, payload = http(block)
    page = text_of(fields, body_of(fields, payload))
    seen = Seen()
    text = "\n".join(plain_text(page, seen)).encode("utf-8", "replace")
    conversion_id, metadata_id = record_id(source, "conversion"), record_id(source, "metadata")
    own, given = digest(payload), value_of(headers, "WARC-Payload-Digest")
    about = {
        "source": headers,
        "http": {"status": status, "headers": fields},
        "payload": {"digest": own, "bytes": len(payload), "digest_holds": given in (None, own)},
        "html": {"title": seen.title, "links": seen.links},
        "conversion": conversion_id,
    }
    body = json.dumps(about, ensure_ascii=False).encode("utf-8", "replace")
    shared = [("WARC-Refers-To", source), ("WARC-Date", date)]
    if target:
        shared += [("WARC-Target-URI", target), ("WARC-Refers-To-Target-URI", target)]
    shared.append(("WARC-Refers-To-Date", date))
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *shared, ("Content-Type", "application/json"), ("WARC-Block-Digest", digest(body))], body)
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *shared, ("Content-Type", "text/plain"), ("WARC-Block-Digest", digest(text))], text)
    return metadata, conversion


def tried(record: bytes | None) -> tuple[bytes | None, bytes | None, str | None]:
    """The derived records, or why there are none; nothing of a null."""
    try:
        return (None, None, None) if record is None else (*derive(record), None)
    except ValueError as e:
        return None, None, str(e)


def response_of(page_id: pa.Array, url: pa.Array, html: pa.Array) -> list[bytes]:
    return [response(i, u, h.encode("utf-8", "replace")) for i, u, h in zip(page_id.to_pylist(), url.to_pylist(), texts(html))]


def responses(pages: DataFrame) -> DataFrame:
    """Adds record, a response record of each page. Null html is an empty payload, a null url leaves out the target URI; repeated rows get equal records."""

    def start():
        return lambda page_id, url, html: [pa.array(response_of(page_id, url, html), pa.binary())]

    return with_arrow(pages, ["page_id", "url", "html"], [T.StructField("record", T.BinaryType())], start)


def derivatives(records: DataFrame) -> DataFrame:
    """Adds metadata and conversion, the records derived from the response record in record, and error.

    All are null where the record is. Where it is malformed, cut short, not of
    a response or without an id or date, there are no derived records, and
    error says so; otherwise it is null.
    """

    def start():
        def run(record):
            made = [tried(r) for r in record.to_pylist()]
            return [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.string()))]

        return run

    kinds = {"metadata": T.BinaryType(), "conversion": T.BinaryType(), "error": T.StringType()}
    return with_arrow(records, ["record"], [T.StructField(n, t) for n, t in kinds.items()], start)


# ---- files

_PLACES = ["part", "wat_at", "wat_size", "wet_at", "wet_size"]


def write_files(
    records: DataFrame, root: str, inputs: Sequence[str] = ("record",), record_of: Callable[..., list[bytes | None]] | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Derives records and writes them to part-N.warc.wat.gz and part-N.warc.wet.gz under root; gives the index.

    ``record_of`` makes the response records from the Arrow columns ``inputs``;
    by default they are in record. The index has the columns ``keep`` (all but
    the inputs, and names of its own give way), and where each row's members
    begin and how long they are; null for rows without derived records, and
    then error says why (null if there was no record). Files get their names
    once they are whole.
    """
    small_batches(records.sparkSession)
    root = qualified(records.sparkSession, root)
    names = records.columns
    at = [names.index(x) for x in inputs]
    own = {*_PLACES, "error"}
    kept = [i for i, x in enumerate(names) if x.lower() not in own and (x in keep if keep is not None else x not in inputs)]
    schema = T.StructType([records.schema.fields[i] for i in kept] + [T.StructField(n, T.LongType()) for n in _PLACES] + [T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, where = pafs.FileSystem.from_uri(root)
        fs.create_dir(where, recursive=True)
        part, mark = TaskContext.get().partitionId(), f"{os.getpid()}-{os.urandom(4).hex()}"
        paths = [f"{where}/part-{part:06d}.warc.{kind}.gz" for kind in ("wat", "wet")]
        outs, ends = [], [0, 0]
        for b in batches:
            outs = outs or [fs.open_output_stream(f"{x}.{mark}", compression=None) for x in paths]
            columns = [b.column(i) for i in at]
            rows = []
            for record in record_of(*columns) if record_of else columns[0].to_pylist():
                metadata, conversion, error = tried(record)
                row: list = [part if metadata else None]
                for k, r in enumerate((metadata, conversion)):
                    member = gzip.compress(r, 1, mtime=0) if r else b""
                    outs[k].write(member)
                    row += [ends[k], len(member)] if r else [None, None]
                    ends[k] += len(member)
                rows.append((*row, error))
            found = list(zip(*rows)) if rows else [()] * (len(_PLACES) + 1)
            made = [pa.array(x, pa.int64()) for x in found[:-1]] + [pa.array(found[-1], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + made, schema.names)
        for out, x in zip(outs, paths):
            out.close()
            fs.move(f"{x}.{mark}", x)

    return Scratch(records.sparkSession, "warc").write(records.mapInArrow(run, schema), "index")


def read_files(index: DataFrame, root: str, fields: Sequence[T.StructField], use: Callable[[bytes | None, bytes | None], tuple]) -> DataFrame:
    """Adds to each row of an index what ``use`` makes of its metadata and conversion records, read from the files at their places."""
    root = qualified(index.sparkSession, root)
    # Rows of a file are read by one task, in their order; the places of a row are that task's only input.
    spread = F.coalesce("part", F.xxhash64(*index.columns))
    near = index.repartition(spread).sortWithinPartitions("part", "wat_at")

    def start():
        from pyspark.sql.pandas.types import to_arrow_type

        fs, where = pafs.FileSystem.from_uri(root)
        kinds = [to_arrow_type(f.dataType) for f in fields]
        held: dict = {"part": None, "files": []}

        def member(k: int, at: int, size: int) -> bytes:
            f = held["files"][k]
            f.seek(at)
            return gzip.decompress(f.read(size))

        def run(*places):
            out = []
            for part, *spots in zip(*[x.to_pylist() for x in places]):
                if part is None:
                    out.append(use(None, None))
                    continue
                if part != held["part"]:
                    for f in held["files"]:
                        f.close()
                    held["part"], held["files"] = part, [fs.open_input_file(f"{where}/part-{part:06d}.warc.{kind}.gz") for kind in ("wat", "wet")]
                out.append(use(member(0, *spots[:2]), member(1, *spots[2:])))
            columns = list(zip(*out)) if out else [()] * len(fields)
            return [pa.array(x, kind) for x, kind in zip(columns, kinds)]

        return run

    return with_arrow(near, _PLACES, fields, start)


_REPORT = [
    *[T.StructField(n, T.StringType()) for n in ("response_id", "metadata_id", "conversion_id", "refers_to", "payload_digest", "text_digest")],
    *[T.StructField(n, T.LongType()) for n in ("n_headers", "n_links", "n_chars")],
]


def said(metadata: bytes | None, conversion: bytes | None) -> tuple:
    """What a page's derived records say, held against one another."""
    if metadata is None or conversion is None:
        return (None,) * len(_REPORT)
    (mh, mb), (ch, cb) = next(parse(metadata)), next(parse(conversion))
    about = json.loads(mb)
    source = value_of(about["source"], "WARC-Record-ID")
    m, c = ({k: value_of(h, f"WARC-{k}") for k in ("Refers-To", "Record-ID", "Block-Digest")} for h in (mh, ch))
    same = m["Refers-To"] == c["Refers-To"] == source and about["conversion"] == c["Record-ID"]
    if not same or digest(cb) != c["Block-Digest"] or digest(mb) != m["Block-Digest"] or not about["payload"]["digest_holds"]:
        raise ValueError(f"records of {source} don't hold together")
    return (source, m["Record-ID"], c["Record-ID"], c["Refers-To"], about["payload"]["digest"], c["Block-Digest"], len(about["source"]), len(about["html"]["links"]), len(cb.decode()))


def report(pages: DataFrame, root: str | None = None) -> DataFrame:
    """page_id, url and what the derived records of each page say, which are written as files under root and read back from them."""
    root = root or f"{Scratch(pages.sparkSession, 'warc').root}/files"
    index = write_files(pages.select("page_id", "url", "html"), root, ["page_id", "url", "html"], response_of, ["page_id", "url"])
    return read_files(index, root, _REPORT, said).select("page_id", "url", *[f.name for f in _REPORT])
