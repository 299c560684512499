"""WARC archives: writing with chunked HTTP framing, segments and revisits, and reassembly on reading.

A page becomes a response record whose block is an HTTP message with chunked transfer framing. A block
over SEGMENT bytes is cut: the first piece stays in the response record, the others follow as
continuation records that name it as their origin. Reading groups the pieces by origin, orders them by
segment number, verifies the total length and undoes the chunked framing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save, small

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
#: Records in an archive file at most: a file holds no more than RECORDS * SEGMENT bytes, headers aside.
RECORDS = 2048
#: Payloads below this size are always written in full.
LEAST_REVISIT = 100
_VERSION = b"WARC/1.1\r\n"
_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class WarcError(ValueError):
    """An archive that breaks the format: a truncated record, a missing segment, a wrong length or digest."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(block: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = block.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk size is missing")
        try:
            n = int(block[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError as e:
            raise WarcError("a chunk size isn't hexadecimal") from e
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if block[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk is cut short")
        parts.append(block[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, dechunked where its header says so."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("an HTTP header has no end")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[ \t]*chunked", head) else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return _VERSION + head.encode("ascii") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of one page."""
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    urn = page_urn(page_id)
    if is_revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", urn), *common, ("WARC-Profile", profile), ("WARC-Refers-To", page_urn(refers_to))], _HTTP + b"\r\n")]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", urn), *common], block)]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", urn), *common, ("WARC-Segment-Number", 1)], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        total = len(block) if k == len(pieces) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{urn[:-1]}:{k}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", urn), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], piece))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive: headers by lower-case name, and the block."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise WarcError(f"no record at byte {at}")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
        size = int(headers.get("content-length", -1))
        start = end + 4
        if size < 0 or start + size > len(data):
            raise WarcError("a record is cut short")
        yield headers, data[start : start + size]
        at = start + size


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    parts = []
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data))
        if not one.eof:
            raise WarcError("a compressed member is cut short")
        data = one.unused_data
    return b"".join(parts)


def _write_rows(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            ids, urls, html, digests, revisit, refers = batch.columns
            for i in range(batch.num_rows):
                payload = html[i].as_buffer().to_pybytes() if html[i].is_valid else b""
                # the writer of text files ends each row with a line feed, the last byte of a record
                made = [r[:-1] for r in records_of(ids[i].as_py(), urls[i].as_py(), payload, digests[i].as_py(), refers[i].as_py(), revisit[i].as_py(), segment)]
                out += made
                size += sum(map(len, made))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, records: int = RECORDS) -> None:
    """Write pages (page_id BIGINT, url STRING, html STRING) as gzip-compressed WARC files under `folder`.

    A null html is an empty payload. Of pages with equal payloads of at least LEAST_REVISIT bytes the one
    with the smallest page_id is written in full and the others revisit it; rows that repeat that page_id
    are written in full too. A null page_id is written as such and is never one that others refer to.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    facts = keyed.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = facts.join(first, "digest").where("not page_id <=> refers_to").distinct().withColumnsRenamed({"page_id": "p", "digest": "d"})
    rows = keyed.join(small(save(revisits, "warc-revisits")), (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    rows = rows.select("page_id", "url", "html", "digest", F.col("d").isNotNull().alias("revisit"), "refers_to")
    text = rows.mapInArrow(_write_rows(segment), "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


_READ = "record_type string, page_id long, url string, digest string, refers_to long, origin string, segment int, total long, block binary"


def _page(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", urn or "")
    return int(m[1]) if m else None


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, block in parse(gunzip(content.as_buffer().to_pybytes())):
                kind, urn, number = h["warc-type"], h["warc-record-id"], h.get("warc-segment-number")
                total = h.get("warc-segment-total-length")
                origin = h.get("warc-segment-origin-id") or (urn if number else None)
                block = payload_of(block) if number is None and kind != "revisit" else block if number else b""
                uri = h.get("warc-target-uri")
                rows.append((kind, _page(origin or urn), uri and unquote(uri), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, _page(h.get("warc-refers-to")), origin, number and int(number), total and int(total), block))
                size += len(block)
                if size > 4_000_000:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def reassemble(pieces: list[tuple[int, int | None, bytes]]) -> tuple[bytes, int]:
    """The block of a segmented record from (number, total length, bytes) in any order, and how often it was written."""
    copies = Counter(n for n, _, _ in pieces)
    by_number = {n: (total, data) for n, total, data in pieces}
    last = max(by_number)
    if sorted(by_number) != list(range(1, last + 1)) or len(set(copies.values())) > 1:
        raise WarcError("a segment is missing")
    block = b"".join(by_number[n][1] for n in range(1, last + 1))
    if by_number[last][0] != len(block):
        raise WarcError("the segments don't have the total length given")
    return block, copies[1]


def _join_segments(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next((r for r in rows if r["segment"] == 1), None)
    if head is None:
        raise WarcError("a first segment is missing")
    block, copies = reassemble([(r["segment"], r["total"], r["block"]) for r in rows])
    payload = payload_of(block)
    return pa.table({"record_type": pa.array([head["record_type"]] * copies), "page_id": pa.array([head["page_id"]] * copies, type=pa.int64()), "url": pa.array([head["url"]] * copies, type=pa.string()), "digest": pa.array([head["digest"]] * copies), "refers_to": pa.array([None] * copies, type=pa.int64()), "payload": pa.array([payload] * copies, type=pa.binary())})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Logical records of the archives under `folder`: record_type, page_id, url, digest, refers_to, payload.

    Segmented records are whole again; a revisit has an empty payload and names the page it refers to.
    A file is read whole by one task, so archives of others should be cut into files that fit into a task's memory.
    Whole records are decoded where they are read; only pieces of segmented ones are shuffled, by origin.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = files.mapInArrow(_read_rows, _READ)
    whole = rows.where("segment is null").select("record_type", "page_id", "url", "digest", "refers_to", F.col("block").alias("payload"))
    cut = rows.where("segment is not null").groupBy("origin").applyInArrow(_join_segments, "record_type string, page_id long, url string, digest string, refers_to long, payload binary")
    return whole.unionByName(cut)


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; sizes of revisits come from the records they refer to."""
    # the archives are read once: only ids, sizes and digests are kept
    own = save(records.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest")), "warc-digests")
    sizes = own.where("record_type = 'response'").groupBy("payload_digest", F.col("page_id").alias("refers_to")).agg(F.max("n").alias("of"))
    joined = own.join(sizes, ["payload_digest", "refers_to"], "left")
    return joined.select("page_id", F.coalesce("of", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
