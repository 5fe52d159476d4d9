import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rowlake.llm import warc
from rowlake.llm.common import Scratch

PARTS = ["\r\n", "\r\n\r\n", "WARC/1.1\r\n", "é日", "x" * 50, "<p>", "0\r\n\r\n", "\n", "1f\r\n"]
payloads = st.lists(st.sampled_from(PARTS), max_size=30).map("".join).map(str.encode)


@settings(max_examples=300, deadline=None)
@given(payloads, st.integers(1, 60))
def test_chunks_round_trip(payload, size):
    out = warc.chunk(payload, size)
    assert warc.dechunk(out) == (payload, True) and warc.BETWEEN not in out


@settings(max_examples=200, deadline=None)
@given(payloads, st.integers(20, 200))
def test_records_hold_no_boundary(payload, segment):
    records = list(warc.response_records(1, "http://x/ y\r\n", payload, warc.record_id(1), segment))
    assert all(warc.BETWEEN not in r + b"\r\n\r\n" and r.startswith(warc.START) for r in records)
    assert (b"\r\n\r\n".join(records) + b"\r\n\r\n").count(warc.BETWEEN) == len(records) - 1
    parsed = [warc.parse_record(r) for r in records]
    assert warc.decode_http(b"".join(p.block for p in parsed))[0] == payload and {p.state for p in parsed} == {"ok"}


def expect(pages, least):
    first = {}
    for k, h in pages:
        body = (h or "").encode()
        if len(body) >= least and k is not None:
            first[body] = min(k, first.get(body, k))
    out, used = [], set()
    for k, h in pages:
        body = (h or "").encode()
        revisit = len(body) >= least and (body in first and (k != first[body] or body in used) or body not in first and body in used)
        if len(body) >= least and (k == first.get(body)):
            used.add(body)
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first.get(body) if revisit else None))
    return sorted(map(str, out))


def pages():
    out = [(i, f"<html>{i % 7}" + "\r\n\r\nWARC/1.1\r\n" * (i % 3) + "é日\r\n" * (i * 13 % 50)) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "z" * 70000 + "\r\n"), (103, "\r\n\r\n"), (104, "same"), (104, "same"), (None, "lost"), (105, "same"), (106, "WARC/1.1\r\nWARC-Type: response")] + [(200 + i, "copied " * 100) for i in range(50)]


@pytest.mark.parametrize("least,segment", [(0, 1 << 18), (0, 300), (20, 64)])
def test_archives(spark, least, segment):
    df = spark.createDataFrame([(k, f"http://h/{k}", h, "x", 1) for k, h in pages()], "page_id long, url string, html string, digest string, length int")
    path = Scratch(spark, "t").path("warc")
    warc.write_archives(df, path, min_revisit=least, segment=segment)
    got = warc.read_archives(spark, path).collect()
    assert {r.state for r in got} == {"ok"}
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expect(pages(), least)
    texts = {(k, (h or "").encode()) for k, h in pages()}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")


def test_lost_segments_are_told(spark):
    records = list(warc.response_records(1, "http://x", b"y" * 5000, warc.record_id(1), 1000))
    for lost in range(len(records)):
        path = Scratch(spark, "t").path("warc")
        kept = [(r.decode(),) for i, r in enumerate(records) if i != lost][::-1]
        spark.createDataFrame(kept, "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
        assert [r.state for r in warc.read_archives(spark, path).collect()] == ["incomplete"]


def test_empty(spark):
    path = Scratch(spark, "t").path("warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.lists(st.sampled_from([b"WARC/1.1\r\n", b"WARC/1.0\r\n", b"1.1\r\n", b"\r\n", b"\r\n\r\n", b"Content-Length: 5", b"content-length:x", b"WARC-Type: response", b"warc-type: revisit", b"WARC-Record-ID: <a>", b"HTTP/1.1 200 OK", b"Transfer-Encoding: chunked", b"5\r\nabcde\r\n", b"0\r\n\r\n", b"zz\r\n", b"\xff\xfe", b"X-Page-Id: 99999999999999999999", b": "]), max_size=14).map(b"".join)))
def test_no_bytes_raise(raw):
    r = warc.parse_record(raw)
    assert r.state in ("ok", "incomplete", "damaged") and warc._decoded(r)[6] in ("ok", "incomplete", "damaged")


def test_records_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\ncontent-LENGTH: 5\r\n\r\nhello"
    record = lambda kind, own, block, *more: b"WARC/1.0\r\n" + b"".join(x + b"\r\n" for x in (b"warc-type:" + kind, b"WARC-RECORD-ID: " + own, *more, b"content-length:  %d" % len(block))) + b"\r\n" + block
    told = base64.b32encode(hashlib.sha1(b"hello").digest())
    records = [
        record(b"response", b"<a>", http, b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha1:" + told, b"WARC-Target-URI: http://x/", b"x-page-id: 7"), record(b"request", b"<q>", b"GET / HTTP/1.0\r\n\r\n"),
        record(b"revisit", b"<r>", b"HTTP/1.0 200 OK\r\n\r\n", b"WARC-Refers-To: <a>"), record(b"resource", b"<s>", b"plain", b"Content-Type: text/plain"), record(b"response", b"<b>", http, b"WARC-Payload-Digest: sha1:AAAA"),
        record(b"response", b"<c>", http)[:-3], b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <d>\r\n\r\n" + http, record(b"response", b"<e>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\nzz"), record(b"response", b"<f>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nhel"),
    ]
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))  # a member a record
    got = {r.record_id: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.record_type, r.state) for k, r in got.items()} == {"<a>": ("response", "ok"), "<r>": ("revisit", "ok"), "<s>": ("resource", "ok"), "<b>": ("response", "damaged"), "<c>": ("response", "incomplete"), "<d>": ("response", "damaged"), "<e>": ("response", "damaged"), "<f>": ("response", "damaged")}
    assert (got["<r>"].refers_to, got["<r>"].refers_to_record, bytes(got["<a>"].payload), bytes(got["<s>"].payload), got["<a>"].target_uri) == (7, "<a>", b"hello", b"plain", "http://x/")
    assert bytes(got["<e>"].payload) == b"hello" and got["<c>"].payload is None
