"""WARC archives: records of pages with revisits, segmentation and chunked transfer coding, written and read back.

Writing: a page becomes a response record of an HTTP message. Of pages with equal payloads of at least `min_revisit`
bytes only that with the smallest page_id carries it; the others become revisit records that refer to it. A payload of
more than CHUNKED bytes goes in chunked transfer coding, and a block of more than `segment` bytes is cut into a first
record and continuation records, with segment numbers, the origin's record id and the total length. Spark's text
writer sets the records' closing CRLF CRLF, so every file is a gzipped WARC file; one task writes one file.

Reading: a file is cut at CRLF CRLF WARC/ by Spark's text reader, one record at a time; being gzipped whole, a file of
this writer is read by one task. The writer keeps that string out of the inside of records (a payload that has it is
chunked within it). Header names match in any case and any version is read. Continuation records are grouped by origin,
ordered by segment number and checked against the total length; then the chunks are decoded and the payload digest is
verified. A group is the segments of one page. Payloads are written once, by their smallest page; equal payloads never
meet in one task, only their digests are grouped, with partial minima. A revisit is resolved by the record id that it
refers to, so archives of other writers are read too; their records have no page_id, but record_id and target_uri.

Bad records never raise: one that is cut off, or whose segments aren't all there, is incomplete; one without a length,
type or id, with broken chunks, or whose payload hasn't the digest or length that its headers tell is damaged. The
payload of either is null, but a damaged one's is what could be decoded. Records of other types than response, revisit
and resource are left out.

Nulls: a null payload is empty; a null page_id comes after all others, and is read back as null. Of repeated rows of a
page and payload one is the response and the others revisit it. An empty table gives an empty archive. Other columns
may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlake.llm.common import map_arrow

SEGMENT, CHUNKED, CHUNK = 256 << 10, 16 << 10, 8 << 10
#: What ends a record and begins the next.
MARK = b"WARC/"
START, BETWEEN = MARK + b"1.1\r\n", b"\r\n\r\n" + MARK
_SPACE = uuid.UUID("8f0e5a3e-2f0b-4d5e-9a57-0d6f5f6b7c11")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def chunk(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding; no chunk holds what begins a record."""
    out, at = [], 0
    while at < len(payload):
        end = at + size
        inside = payload.find(MARK, at, end + len(MARK) - 1)
        if 0 <= inside < end:
            end = inside + 1
        part = payload[at:end]
        out.append(b"%x\r\n%s\r\n" % (len(part), part))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> tuple[bytes, bool]:
    """What the chunks hold, and whether they are whole up to the last."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;.*)?", body[at:line], re.S) if line >= 0 else None
        if not size:
            return b"".join(out), False
        n = int(size[1], 16)
        if not n:
            return b"".join(out), True
        part = body[line + 2 : line + 2 + n]
        out.append(part)
        if len(part) < n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            return b"".join(out), False
        at = line + 4 + n


def _record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return START + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def response_records(page, url: str | None, payload: bytes, own_id: str, segment: int = SEGMENT) -> Iterator[bytes]:
    digest = "sha1:" + base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    if len(payload) > CHUNKED or BETWEEN in block:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunk(payload)
    common = {"WARC-Target-URI": _clean(url), "WARC-Date": "2024-01-01T00:00:00Z", "X-Page-Id": page}
    first = {"WARC-Type": "response", "WARC-Record-ID": own_id, **common, "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        yield _record(first, block)
        return
    number, at = 1, 0
    while at < len(block):
        end = at + segment
        while block[end : end + len(MARK)] == MARK:  # no segment begins as a record does
            end += 1
        part, last = block[at:end], end >= len(block)
        if number == 1:
            yield _record({**first, "WARC-Segment-Number": 1}, part)
        else:
            yield _record({"WARC-Type": "continuation", "WARC-Record-ID": record_id(own_id, number), **common, "WARC-Segment-Origin-ID": own_id, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": len(block) if last else None}, part)
        number, at = number + 1, end


def revisit_record(page, url: str | None, digest: str, length: int, origin: str, own_id: str) -> bytes:
    headers = {
        "WARC-Type": "revisit", "WARC-Record-ID": own_id, "WARC-Target-URI": _clean(url), "WARC-Date": "2024-01-01T00:00:00Z", "X-Page-Id": page, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": origin, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
    }
    return _record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length)


def _write(segment: int, min_revisit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, url, payload, length, digest, revisit, origin_page in (tuple(x.as_py() for x in r) for r in zip(*batch.columns)):
                row += 1
                if not row - 1:
                    out.append(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", task, digest, page), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                if revisit:
                    name = base64.b32encode(bytes.fromhex(digest)).decode()
                    out.append(revisit_record(page, url, name, length, record_id(origin_page, digest), record_id(page, digest, task, row)))
                else:
                    payload = payload or b""
                    own = record_id(page, digest) if length >= min_revisit else record_id(page, digest, task, row)
                    out += response_records(page, url, payload, own, segment)
                size += len(payload or b"")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 0, segment: int = SEGMENT) -> None:
    """Writes the pages as gzipped WARC files below path."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary"), F.lit(b""))
    page = F.col(f"`{key}`").cast("long")
    rows = pages.select(page.alias("page"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("length"), F.sha1(body).alias("digest"))
    same, fresh = ["digest", "length"], [F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("origin")]
    row = F.concat_ws("/", F.coalesce(F.col("page").cast("string"), F.lit("-")), "digest").alias("row")
    narrow = rows.filter(F.col("length") >= min_revisit).drop("body")
    firsts = narrow.groupBy(*same).agg(F.min("page").alias("page"), F.count("*").alias("n"))
    # payloads move once, to their own page and digest
    full = rows.filter(F.col("length") >= min_revisit).withColumn("row", row).join(firsts.select(row), "row", "left_semi").dropDuplicates(["row"])
    full = full.select("page", "url", "body", *reversed(same), *fresh).unionByName(rows.filter(F.col("length") < min_revisit).select("page", "url", "body", *reversed(same), *fresh))
    narrow = narrow.join(firsts.filter("n > 1").withColumnRenamed("page", "origin"), same)
    later = narrow.filter("not page <=> origin").select("page", "url", "length", "digest", "origin")
    again = narrow.filter("page <=> origin").groupBy("page", "length", "digest", "origin").agg(F.count("*").alias("k"), F.min("url").alias("url")).filter("k > 1")
    again = again.select("page", "url", "length", "digest", "origin", F.explode(F.sequence(F.lit(2), F.col("k")))).drop("col")
    revisits = later.unionByName(again).select("page", "url", F.lit(None).cast("binary").alias("body"), "length", "digest", F.lit(True).alias("revisit"), "origin")
    records = map_arrow(full.unionByName(revisits), _write(segment, min_revisit), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


@dataclass
class Record:
    """A record as it was read; state is ok, incomplete or damaged."""

    id: str | None
    kind: str
    page: int | None
    uri: str | None
    refers_to: str | None
    digest: str
    http: bool
    number: int | None
    origin: str | None
    total: int | None
    block: bytes
    state: str


def parse_record(raw: bytes) -> Record:
    """A record without the end or beginning that the reader has cut off; any bytes give one."""
    raw = raw.removeprefix(MARK)
    version, _, rest = raw.partition(b"\r\n")
    head, there, rest = (b"\r\n" + rest).partition(b"\r\n\r\n")
    headers: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip().lower(), value.strip())
    whole = lambda x, least=0: int(v) if re.fullmatch(r"-?[0-9]{1,18}", v := headers.get(x, ""), re.A) and int(v) >= least else None
    length, kind = whole("content-length"), headers.get("warc-type", "").lower()
    own, digest = headers.get("warc-record-id"), headers.get("warc-payload-digest", "")
    state = "damaged" if not there or length is None or not kind or not own or not re.fullmatch(rb"\d+\.\d+", version) else "incomplete" if len(rest) < length else "ok"
    digest = digest[5:].upper() if digest.lower().startswith("sha1:") else ""
    http = "application/http" in headers.get("content-type", "application/http").lower()
    return Record(own, kind, whole("x-page-id", -(10**18)), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, http, whole("warc-segment-number", 1), headers.get("warc-segment-origin-id"), whole("warc-segment-total-length"), rest[:length] if state == "ok" else rest, state)


def decode_http(block: bytes) -> tuple[bytes, int, bool]:
    """The payload of an HTTP message, the length that its header tells, and whether it is whole."""
    head, there, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head):
        body, whole = dechunk(body)
        return body, len(body), whole
    told = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
    return body, int(told[1]) if told else len(body), bool(there)


_KINDS = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("state", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string())]
_OUT = "page_id long, record_type string, refers_to_record string, payload_bytes long, payload_digest string, payload binary, state string, record_id string, target_uri string"
_SEGMENTS = [("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("http", pa.bool_()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("state", pa.string())]


def _packed(rows: list[tuple], kinds: list) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def _decoded(r: Record) -> tuple:
    if r.state == "incomplete":
        return r.page, r.kind, r.refers_to, None, r.digest, None, r.state, r.id, r.uri
    payload, length, whole = decode_http(r.block) if r.http and r.kind != "resource" else (r.block, len(r.block), True)
    if r.kind == "revisit":
        return r.page, r.kind, r.refers_to, length, r.digest, None, r.state, r.id, r.uri
    digest = base32_sha1(payload)
    state = "ok" if r.state == "ok" and whole and r.digest in ("", digest) and length == len(payload) else "damaged"
    return r.page, r.kind or "response", r.refers_to, len(payload), digest, payload, state, r.id, r.uri


def _rows(batches: Iterator[pa.RecordBatch], kinds: list, row) -> Iterator[pa.RecordBatch]:
    """The rows that row(record) gives of the records that are wanted, a few megabytes at a time."""
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for raw in batch.column(0):
            r = parse_record(raw.as_py() or b"")
            if r.kind in ("response", "revisit", "resource", "continuation") or r.state != "ok" and raw.as_py().strip():
                rows.append(row(r))
                size += len(r.block)
            if size > 1 << 22:
                yield from _packed(rows, kinds)
                rows, size = [], 0
        yield from _packed(rows, kinds)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(batches, _KINDS, _decoded)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(batches, _SEGMENTS, lambda r: (r.page, r.id, r.uri, r.digest, r.http, r.origin or r.id, min(r.number or 0, 1 << 30), r.total, r.block, r.state))


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page, own, uri, digest, http, complete, block in zip(*(c.to_pylist() for c in batch.columns)):
            yield from _packed([_decoded(Record(own, "response", page, uri, None, digest or "", http, 1, None, None, block, "ok" if complete else "incomplete"))], _KINDS)


def read_archives(spark, path: str) -> DataFrame:
    """One row per response, revisit or resource: page_id, record_type, refers_to (a page_id), payload_bytes, payload_digest, payload, state (ok, incomplete, damaged), record_id, target_uri and refers_to_record."""
    lines = spark.read.option("lineSep", BETWEEN.decode()).text(path)
    head = F.substring_index("value", "\r\n\r\n", 1)
    named = lambda name: F.regexp_extract(head, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    segment, value = named("WARC-Segment-Number") != "", F.col("value").cast("binary")
    whole = map_arrow(lines.filter(~segment).select(value), _read, _OUT)
    parts = map_arrow(lines.filter(segment).select(value), _segments, ", ".join(f"{n} {'long' if k == pa.int64() else 'int' if k == pa.int32() else 'boolean' if k == pa.bool_() else k}" for n, k in _SEGMENTS))
    cut = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "page_id", "record_id", "target_uri", "digest", "http", "total", "state", "block"))).alias("s"))
    joined = F.expr("aggregate(s, cast('' as binary), (a, x) -> concat(a, x.block))")
    ordered = F.expr("transform(s, x -> x.number) = transform(s, (x, i) -> i + 1) and forall(s, x -> x.state = 'ok')")
    first = F.col("s")[0]
    cut = cut.select(first["page_id"].alias("page"), first["record_id"].alias("own"), first["target_uri"].alias("uri"), first["digest"].alias("digest"), first["http"].alias("http"), ordered.alias("ordered"), F.element_at("s", -1)["total"].alias("total"), joined.alias("block"))
    cut = cut.select("page", "own", "uri", "digest", "http", F.coalesce(F.col("ordered") & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("complete"), "block")
    rows = whole.unionByName(map_arrow(cut, _join_segments, _OUT))
    pages = lines.select(named("WARC-Record-ID").alias("refers_to_record"), F.lower(named("WARC-Type")).alias("kind"), named("X-Page-Id").try_cast("long").alias("refers_to"))
    pages = pages.filter("kind = 'response' and refers_to is not null").groupBy("refers_to_record").agg(F.min("refers_to").alias("refers_to"))  # of narrow columns, in the JVM
    plain, revisits = rows.filter("refers_to_record is null").withColumn("refers_to", F.lit(None).cast("long")), rows.filter("refers_to_record is not null")
    out = plain.unionByName(revisits.join(pages, "refers_to_record", "left"))
    return out.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "state", "record_id", "target_uri", "refers_to_record")
