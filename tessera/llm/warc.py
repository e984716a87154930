"""WARC archives: a native writer and a salvage reader.

Writing: one record a row. A payload's first row is a ``response`` record, later ones with an equal payload are
``revisit`` records that refer to it. The records are strings, and Spark's text writer sets the closing
``CRLF CRLF`` between them, so each part file is a plain WARC file on any file system that Spark writes.
``write_warc(compress=True)`` makes each record a gzip member of its own.

Reading: each file is checked record by record (version line, header, length, closing, payload digest). Where a check
fails, the reader searches for the next version line or gzip member that opens a valid record, goes on there, and
reports the bytes between as a quarantined gap with the reason.

Defined results: null html is an empty payload; null urls are written as ``urn:x-null``, white space and control
characters in urls are percent-encoded; a null page id is written and read as null; rows that repeat both id and payload
are equal records of the same type; an empty table gives no records. Other columns are not read. A file is held in memory
while it is read, so the writer bounds the payload bytes of a file: payloads are written by classes of size, each with as many
records a file as its largest payloads allow; a record is never split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, make_dir, map_arrow, remove

CRLF = "\r\n"
END = CRLF + CRLF
#: The digits of base 32 by Spark's conv() and by RFC 4648.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1, of built-in functions: 20 bits at a time are five hexadecimal and four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def plan_records(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Rows with ``_id, _url, _body, _digest, _bytes, _first``; ``_first`` is the id that a revisit refers to, else null."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), body.alias("_body"))
    keyed = rows.select("_id", base32_sha1(F.col("_body").cast("binary")).alias("_digest"), F.octet_length("_body").cast("long").alias("_bytes"))
    # only digests that two ids share need a decision: few rows, made without any payload
    keyed = scratch.save(keyed.distinct(), "keyed")
    shared = keyed.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    shared = scratch.save(shared.drop("_n"), "shared")
    revisits = keyed.join(shared, "_digest").where(~F.col("_id").eqNullSafe(F.col("_first"))).select(F.col("_id").alias("_rid"), F.col("_digest").alias("_rdigest"), "_first")
    revisits = scratch.save(revisits, "revisits")
    rows = rows.withColumn("_digest", base32_sha1(F.col("_body").cast("binary"))).withColumn("_bytes", F.octet_length("_body").cast("long"))
    on = rows["_id"].eqNullSafe(revisits["_rid"]) & (rows["_digest"] == revisits["_rdigest"])
    return rows.join(revisits, on, "left").drop("_rid", "_rdigest")


def _records() -> Column:
    http = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + END
    revisit = F.col("_first").isNotNull()
    uri = F.coalesce(F.regexp_replace(F.regexp_replace(F.col("_url"), r"\s", "%20"), r"[\x00-\x20\x7f]", "%00"), F.lit("urn:x-null"))
    record = lambda i: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(i).cast("string"), F.lit("null")), F.lit(">"))
    length = F.when(revisit, F.lit(len(http))).otherwise(F.lit(len(http)) + F.col("_bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), record("_id"),
        F.lit(CRLF + "WARC-Date: 2024-01-01T00:00:00Z" + CRLF + "WARC-Target-URI: "), uri,
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.lit(CRLF + "WARC-Payload-Length: "), F.col("_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), record("_first"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Length: "), length.cast("string"), F.lit(END + http),
    )
    return F.when(revisit, head).otherwise(F.concat(head, F.col("_body")))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gzip members without their last byte, which is 0 for under 16 MiB; larger ones end in an empty member."""
    for batch in batches:
        out = []
        for text in batch.column(0).cast(pa.binary()):
            data = text.as_py() + END.encode()
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            made = z.compress(data) + z.flush()
            if made[-1]:
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                made += z.compress(b"") + z.flush()
            out.append(made[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


#: Largest payloads of the classes of size, in bytes; a last class has what is larger.
SIZES = (16 << 10, 512 << 10)


def size_classes(largest: list[tuple[int, int]], max_records: int, max_bytes: int) -> list[tuple[int, int]]:
    """``(class, records a file)`` for ``(class, bytes of its largest payload)``: so many records hold ``max_bytes`` at most,
    or one record if that alone is larger."""
    return [(c, max(1, min(max_records, max_bytes // max(n, 1)))) for c, n in sorted(largest)]


def write_warc(pages: DataFrame, path: str, scratch: Scratch, *, min_revisit_bytes: int = 0, compress: bool = False, max_records: int = 20_000, max_bytes: int = 128 << 20, **cols: str) -> None:
    """Writes one record per row below ``path``; several files, each a WARC file of its own.

    A file holds ``max_records`` records and ``max_bytes`` of payload at most (before compression), unless a single payload is
    larger. Each class of size that occurs is a folder below ``path`` and a pass over the pages; most tables have one or two.
    """
    records = plan_records(pages, scratch, min_revisit_bytes, **cols)
    of = F.when(F.col("_bytes") <= SIZES[0], 0).when(F.col("_bytes") <= SIZES[1], 1).otherwise(2)
    keyed = scratch.read("keyed").groupBy(of.alias("c")).agg(F.max("_bytes").alias("n"))
    remove(scratch.spark, path)
    make_dir(scratch.spark, path)
    for c, count in size_classes([tuple(r) for r in keyed.collect()], max_records, max_bytes):
        lines = records.where(of == c).select(_records().alias("value"))
        ends = END
        if compress:
            lines, ends = map_arrow(lines, _members, "value binary").select(F.col("value").cast("string").alias("value")), "\x00"
        lines.write.mode("overwrite").option("lineSep", ends).option("maxRecordsPerFile", count).text(f"{path}/size-{c}")


VERSION = re.compile(rb"WARC/(?:1\.[01]|0\.1[78])\r\n")
GZIP = b"\x1f\x8b\x08"
OPENS = re.compile(VERSION.pattern + b"|" + re.escape(GZIP))


@dataclass
class Record:
    offset: int
    length: int
    fields: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _spelt(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _base32(digest: str) -> str:
    """A SHA-1 in base 32 as it is, or from its 40 hexadecimal digits."""
    return _spelt(bytes.fromhex(digest)) if re.fullmatch(r"[0-9A-Fa-f]{40}", digest) else digest.upper()


def _parse(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at ``at`` and where it ends, or the reason why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header does not end"
    if VERSION.search(data, version.end(), stop + 2):
        return None, at, "header is cut short"
    fields = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without a colon"
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None, at, "header lacks its length or type"
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "record is cut short or its length is wrong"
    payload = data[begin:end]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and fields["warc-type"] != "revisit" and _spelt(hashlib.sha1(payload).digest()) != _base32(digest[5:]):
        return None, at, "payload digest differs"
    return Record(at, end + 4 - at, fields, payload), end + 4, ""


def _at(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What opens at ``at``, a plain record or the records of a gzip member, and where it ends; the reason if there is no
    record, and where to look on. An empty member has neither records nor a reason."""
    if not data.startswith(GZIP, at):
        record, end, why = _parse(data, at)
        return [record] if record else [], end, why
    found = _first_member(data, at)
    if found is None:
        return [], at, "member does not inflate"
    made, end = found
    if not made:
        return [], end, ""
    record, stop, why = _parse(made, 0)
    inside = [record] if record and stop == len(made) else list(salvage(made))
    if not any(isinstance(x, Record) for x in inside):
        return [], end, why
    # what shares a member has the member's place, and the first of it the member's bytes
    for n, x in enumerate(inside):
        x.offset, x.length = at, 0 if n else end - at
        if isinstance(x, Gap):
            x.reason = f"inside a member: {x.reason}"
    return inside, end, ""


def _first_member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The member that opens at ``at`` and where it ends, else None."""
    z = zlib.decompressobj(31)
    out, to, step = [], at, 1 << 14
    try:
        while not z.eof:
            if to >= len(data):
                return None
            out.append(z.decompress(data[to : to + step]))
            to = min(to + step, len(data))
    except zlib.error:
        return None
    return b"".join(out), to - len(z.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in order; together they cover every byte of it (but empty gzip members).

    A gzip member may hold several records, and damage between them. Behind damage it goes on at the nearest valid record, be it plain or a gzip member.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        met, end, bad = _at(data, at)
        if bad:
            gap, why = (at if gap is None else gap), why or bad
            found = OPENS.search(data, max(end, at + 1))
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield Gap(gap, at - gap, why)
            gap, why = None, ""
        yield from met
        at = end
    if gap is not None:
        yield Gap(gap, len(data) - gap, why)


READ = "path string, kind string, offset long, length long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _read(with_payload: bool):  # noqa: ANN202
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.binary() if n == "payload" else pa.int64() if n in ("offset", "length", "payload_length") else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((path.as_py(), "gap", x.offset, x.length, x.reason, None, None, None, None, None, None, None))
                    else:
                        f = x.fields
                        size = f.get("warc-payload-length") if f["warc-type"] == "revisit" else len(x.payload)
                        digest = _base32(f.get("warc-payload-digest", "").removeprefix("sha1:")) if f["warc-type"] == "revisit" else _spelt(hashlib.sha1(x.payload).digest())
                        rows.append((path.as_py(), "record", x.offset, x.length, None, f["warc-type"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, None if size is None else int(size), x.payload if with_payload else None))
                        held += len(x.payload) * with_payload
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined byte gaps (``kind = 'gap'``) of all archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return map_arrow(files, _read(with_payload), READ)


def page_of(record_id: str) -> Column:
    """The page id in a record id of ``write_warc``; null if it was written as null."""
    return F.regexp_extract(F.col(record_id), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
