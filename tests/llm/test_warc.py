import base64
import gzip
import hashlib
import json

import pytest

from voxelloom.llm import warc as w

PAGE = "page_id long, url string, html string"
HTML = "<html><head><title>A  title</title></head><body><nav><a href='/x'>X</a></nav><p>Text &amp; <a href=\"http://y/\">more</a></p></body></html>"


def test_records_are_linked():
    record = w.response(7, "http://a/b", HTML.encode())
    (h, block), = w.parse(record)
    assert w.value_of(h, "warc-type") == "response" and block.endswith(HTML.encode()) and int(w.value_of(h, "Content-Length")) == len(block)
    sha = "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    assert w.value_of(h, "WARC-Payload-Digest") == sha
    metadata, conversion = w.derive(record)
    (mh, mb), = w.parse(metadata)
    (ch, cb), = w.parse(conversion)
    about, m, c = json.loads(mb), dict(mh), dict(ch)
    assert m["WARC-Refers-To"] == c["WARC-Refers-To"] == dict(h)["WARC-Record-ID"] and about["conversion"] == c["WARC-Record-ID"]
    assert (m["WARC-Type"], c["WARC-Type"], c["Content-Type"]) == ("metadata", "conversion", "text/plain")
    assert about["source"] == [list(x) for x in h] and about["payload"]["digest"] == sha and about["payload"]["digest_holds"]
    assert about["html"] == {"title": "A title", "links": ["/x", "http://y/"]} and dict(about["http"]["headers"])["Content-Type"].startswith("text/html")
    assert cb.decode() == "X\nText & more" and c["WARC-Target-URI"] == "http://a/b" and w.digest(cb) == c["WARC-Block-Digest"]
    assert w.derive(record) == (metadata, conversion)


def test_repeated_and_folded_headers_stay():
    block = b"HTTP/1.1 200 OK\r\nset-cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\nEmpty:\r\n\r\n<p>x</p>"
    given = [("WARC-Type", "Response"), ("warc-record-id", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("WARC-IP-Address", "::1")]
    metadata, conversion = w.derive(w.build(given, block))
    about = json.loads(next(w.parse(metadata))[1])
    assert [tuple(x) for x in about["source"]] == [*given, ("Content-Length", str(len(block)))]
    assert [tuple(x) for x in about["http"]["headers"]] == [("set-cookie", "a=1"), ("Set-Cookie", "b=2"), ("X-Long", "one two"), ("Empty", "")]
    assert w.value_of(next(w.parse(conversion))[0], "WARC-Refers-To") == "<urn:uuid:1>"


def test_charsets_and_codings():
    page = "<html><head>{}</head><p>caf\xe9 \u20ac</p>"

    def text(head, body):
        block = b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n\r\n" + body
        return next(w.parse(w.derive(w.build([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Date", "d")], block))[1]))[1].decode()

    plain, latin = page.format(""), page.format('<meta charset="windows-1252">')
    want = "caf\xe9 \u20ac"
    assert text("Content-Type: text/html; charset=windows-1252", plain.encode("cp1252")) == want
    assert text("Content-Type: text/html", latin.encode("cp1252")) == want
    assert text("Content-Type: text/html; charset=ISO-8859-15", latin.encode("iso-8859-15")) == want
    assert text("Content-Type: text/html; charset=no-such", plain.encode()) == want and text("X: y", b"\xef\xbb\xbf" + latin.encode()) == want
    assert text("Content-Type: text/html", plain.encode("cp1252")) == "caf\ufffd \ufffd"
    assert text("Content-Encoding: gzip", gzip.compress(plain.encode())) == want
    assert text("Content-Encoding: gzip", plain.encode()) == want
    for odd in ("base64", "hex", "idna", "punycode", "utf-7", "rot13"):
        assert isinstance(text(f"Content-Type: text/html; charset={odd}", plain.encode()), str)


def test_parse_round_trip_and_damage():
    records = [w.build([("WARC-Type", "x"), ("Name", "a\r\nb")], b) for b in (b"", b"\r\n\r\n", bytes(range(256)))]
    got = list(w.parse(b"".join(records)))
    assert [b for _, b in got] == [b"", b"\r\n\r\n", bytes(range(256))] and w.value_of(got[0][0], "Name") == "a b"
    for bad in (records[2][:-9], b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1", b"WARC/1.1\r\nContent-Length: -4\r\n\r\n", b"WARC/1.1\r\nX: y\r\n\r\n"):
        with pytest.raises(ValueError):
            list(w.parse(bad))


def test_malformed_records_become_errors(spark):
    good = w.response(1, "u", HTML.encode())
    bad = [b"", good[:-3], b"junk", w.build([("WARC-Type", "request")], b"x"), w.build([("WARC-Type", "response"), ("WARC-Date", "d")], b"x"), w.build([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"x")]
    rows = [(0, good, "q"), (1, None, "q")] + [(2 + k, b, "q") for k, b in enumerate(bad)]
    got = {r.k: r for r in w.derivatives(spark.createDataFrame(rows, "k int, record binary, error string")).collect()}
    assert got[0].error is None and got[0].metadata and (got[1].metadata, got[1].error) == (None, None)
    assert [got[2 + k].error for k in range(6)] == ["empty", "cut short", "no end of headers", "not a response", "no WARC-Record-ID", "no WARC-Date"]
    assert all(got[2 + k].conversion is None for k in range(6))


def test_report_and_edge_rows(spark):
    rows = [(1, "http://a/", HTML, "q"), (1, "http://a/", HTML, "q"), (None, None, None, "q"), (2, "http://b/\nX: y", "", "q"), (3, "u", "<p>" + "word " * 100_000, "q")]
    got = sorted(w.report(spark.createDataFrame(rows, PAGE + ", record string")).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == 5 and got[0] == got[1] and got[0].refers_to == got[0].response_id and got[0].n_links == 2
    assert got[4].n_chars == 0 and got[2].text_digest == w.digest(b"") and got[3].n_chars == 499_999
    assert len({r.response_id for r in got}) == 4
    assert w.report(spark.createDataFrame([], PAGE)).count() == 0


def test_report_of_the_whole_table(spark, sf):
    """Against records made and taken apart one by one, without files."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((p.page_id, p.url, *w.said(*w.derive(w.response(p.page_id, p.url, (p.html or "").encode())))) for p in pages.collect())
    assert sorted(map(tuple, w.report(pages.repartition(3)).collect())) == want


def test_files_are_gzip_members(spark, tmp_path):
    rows = [(k, f"http://a/{k}", HTML) for k in range(10)]
    records = w.responses(spark.createDataFrame(rows, PAGE).repartition(2)).drop("html")
    broken = spark.createDataFrame([(99, "u", b"junk"), (98, "u", None)], "page_id long, url string, record binary")
    index = w.write_files(records.unionByName(broken), str(tmp_path))
    assert index.columns == ["page_id", "url", "part", "wat_at", "wat_size", "wet_at", "wet_size", "error"]
    assert sorted((r.page_id, r.error) for r in index.filter("part IS NULL").collect()) == [(98, None), (99, "no end of headers")]
    ids = [w.value_of(h, "WARC-Refers-To") for f in sorted(tmp_path.iterdir()) if f.suffix == ".gz" for h, _ in w.parse(gzip.decompress(f.read_bytes()))]
    assert len(ids) == 20 and len(set(ids)) == 10
    fields = [w.T.StructField("metadata", w.T.BinaryType()), w.T.StructField("conversion", w.T.BinaryType())]
    got = {r.page_id: r for r in w.read_files(index, str(tmp_path), fields, lambda m, c: (m, c)).collect()}
    assert len(got) == 12 and got[99].metadata is None
    assert all((got[k].metadata, got[k].conversion) == w.derive(w.response(k, f"http://a/{k}", HTML.encode())) for k in range(10))
