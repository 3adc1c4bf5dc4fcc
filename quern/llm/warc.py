"""WARC archives of pages: writing with revisits, segments and chunked framing, and reading back by reassembly.

Writing uses DataFrame functions.  Of pages with one payload, that with the smallest page_id becomes a response and the
others revisit it.  A block of more than SEGMENT bytes is cut: the first record has WARC-Segment-Number 1, the rest are
continuation records that name it as origin, the last of them with the total length.  HTTP bodies are chunked.  An archive
file is a text file whose line separator is the end of a WARC record, which keeps the bytes exact; it holds at most
RECORDS records, which bounds its size.

Reading parses the archives by Content-Length, groups continuation records by origin, orders them by segment number,
holds the sum against the total length, and takes the chunks off.

Defined cases: a null html is an empty payload; rows that repeat a page_id and payload are all responses if that is the smallest
page_id, else all revisits; a null page_id counts as larger than any other; records that are cut short, out of order or of the wrong length come back with
``whole`` false and no payload; very long payloads are cut into segments and chunks whose number grows with them, and each byte is copied a
fixed number of times; an empty table gives archives without records; other columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import new_path, salted_lookup, trimmed

#: Bytes of a block in one record, of a chunk of a body, and records of an archive file.
SEGMENT, CHUNK, RECORDS = 48 * 1024, 8 * 1024, 512
END = "\r\n\r\n"
#: Payloads of at least so many bytes are revisited when they come again.
LEAST_REVISITED = 0
_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32: eight groups of 20 bits, each written as four digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.upper(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX, _B32)


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def joined(parts: Column) -> Column:
    """The bytes of an array of byte strings, copied once; as strings they stay the bytes they are."""
    return F.array_join(F.transform(parts, lambda p: p.cast("string")), "").cast("binary")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to).

    The smallest page of each payload is found with partial sums; only payloads that occur twice are looked up, with each
    payload's rows dealt over many tasks.
    """
    one = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), _bytes(F.coalesce(html, F.lit(""))).alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    firsts = one.filter(F.octet_length("payload") >= LEAST_REVISITED).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    out = salted_lookup(one, firsts, "payload_digest", F.col("page_id"), "__n")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"))


def records(typed: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """(record) of a table of ``with_revisits``: whole WARC records as strings of bytes, without their end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    size = F.octet_length("payload")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda a: F.concat(_bytes(F.concat(F.lower(F.hex(F.least(F.lit(chunk), size - a))), F.lit("\r\n"))), F.substring("payload", a + 1, F.lit(chunk)), F.lit(b"\r\n")))
    chunked = joined(chunks)
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n")
    block = F.when(F.col("record_type") == "response", F.concat(_bytes(head), chunked, F.lit(b"0\r\n\r\n"))).otherwise(_bytes(head))
    common = F.concat(
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", size),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
    )
    one = typed.select(F.expr("uuid()").alias("id"), "record_type", "refers_to", common.alias("common"), block.alias("block"))
    cuts = F.sequence(F.lit(0), F.greatest(F.octet_length("block") - 1, F.lit(0)), F.lit(segment))
    # bodies are cut before they are dealt into rows: no row carries the whole block
    bodies = F.transform(cuts, lambda at: F.substring("block", at + 1, F.lit(segment)))
    whole = one.select("id", "record_type", "refers_to", "common", F.octet_length("block").alias("total"), F.size(cuts).alias("segments"), bodies.alias("bodies"))
    cut = whole.select("id", "record_type", "refers_to", "common", "total", "segments", F.posexplode("bodies").alias("k", "body"))
    urn = lambda v: F.concat(F.lit("<urn:uuid:"), v, F.lit(">"))
    later = F.col("k") > 0
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(later, "continuation").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", urn(F.when(later, F.expr("uuid()")).otherwise(F.col("id")))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.col("common"),
        F.when(F.col("segments") > 1, line("WARC-Segment-Number", F.col("k") + 1)).otherwise(F.lit("")),
        F.when(later, line("WARC-Segment-Origin-ID", urn(F.col("id")))).otherwise(F.lit("")),
        F.when(later & (F.col("k") == F.col("segments") - 1), line("WARC-Segment-Total-Length", F.col("total"))).otherwise(F.lit("")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("X-Refers-To-Page", F.col("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body")),
        F.lit("\r\n"),
    )
    return cut.select(F.concat(_bytes(header), F.col("body")).cast("string").alias("record"))


def write(pages: DataFrame, path: str | None = None) -> str:
    """Writes archives and returns their folder."""
    path = path or new_path(pages.sparkSession, "warc")
    records(with_revisits(pages)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


# -- reading


def unchunked(body: bytes) -> bytes | None:
    """A chunked body's payload, or None if its framing is broken."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; a record that is cut short ends the archive."""
    at = 0
    while (end := archive.find(b"\r\n\r\n", at)) >= 0:
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", "-1"))
        if not lines[0].startswith("WARC/") or size < 0 or end + 4 + size > len(archive):
            return
        yield headers, archive[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_SEGMENTS = "origin string, number int, total long, record_type string, page_id string, refers_to string, digest string, length long, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in _SEGMENTS.split(", ")])

    for batch in batches:
        for value in batch.column(0):
            data = value.as_py()
            archive = zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data
            rows = []
            for h, block in parsed(archive):
                kind = h.get("warc-type", "")
                rows.append((
                    h.get("warc-segment-origin-id", h.get("warc-record-id")), int(h["warc-segment-number"]) if "warc-segment-number" in h else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                    None if kind == "continuation" else kind, h.get("x-page-id"), h.get("x-refers-to-page"), h.get("warc-payload-digest"), int(h.get("x-payload-length", "-1")), block,
                ))
                if len(rows) >= 200:
                    yield made(rows)
                    rows = []
            yield made(rows)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(trimmed(_parse), _SEGMENTS)


def reassembled(found: DataFrame) -> DataFrame:
    """(origin, record_type, page_id, refers_to, digest, length, block): blocks of all segments in order, null if not whole.

    A record without segments passes as it is; only those with segments are gathered by their origin.
    """
    plain = found.filter("number is null").drop("number", "total")
    parts = found.filter("number is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *(F.max_by(c, F.when(F.col("record_type").isNotNull(), 1)).alias(c) for c in ("record_type", "page_id", "refers_to", "digest", "length")),
    )
    block = joined(F.transform("parts", lambda p: p["block"]))
    numbered = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    whole = F.when(numbered & (F.octet_length(block) == F.col("total")), block)
    return plain.unionByName(parts.select("origin", "record_type", "page_id", "refers_to", "digest", "length", whole.alias("block")))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, sums, fits = [], [], []
        for kind, block, digest in zip(batch.column("record_type"), batch.column("block"), batch.column("digest"), strict=True):
            block, payload = block.as_py(), None
            if block is not None and kind.as_py() == "response":
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
            payloads.append(payload)
            sums.append(own)
            fits.append(kind.as_py() == "revisit" and block is not None or own is not None and f"sha1:{own}" == digest.as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(sums, pa.string()), pa.array(fits, pa.bool_())], [*batch.schema.names, "payload", "payload_sha1", "whole"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload, payload_bytes, payload_digest, whole) of the archives in a folder.

    A revisit has no payload of its own; its digest and length are those its record states of the full payload.
    """
    rows = reassembled(segments(spark, path))
    schema = "origin string, record_type string, page_id string, refers_to string, digest string, length long, block binary, payload binary, payload_sha1 string, whole boolean"
    out = rows.select("origin", "record_type", "page_id", "refers_to", "digest", "length", "block").mapInArrow(trimmed(_decode), schema)
    return out.select(
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
        "payload",
        F.when(F.col("record_type") == "revisit", F.col("length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "whole",
    )
