"""Legacy ARC archives turned into WARC archives, and WARC archives read back.

An ARC file starts with a version block that names the fields of its record lines; each
record is such a line, whose last field declares the length of the body, and the body.
The converter reads the lines by their version, and makes the WARC identifier, date, type
and digests that ARC lacks. Payloads are bytes, whatever their character set. Archives are
files of gzip members, one for each record, written through Spark's text sink: a member of
less than 16 MiB ends in a zero byte, which serves as the sink's line end. They are read by
its binary source, a file at a time - what one task wrote, so about a scan split - and a
record of it at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm.common import cut, forget, in_small_batches, scratch_path

#: The fields of a record line in ARC versions 1 and 2.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SOFTWARE = "shoebox"
#: Bytes of a gzip member at most, so that the last byte of its length is zero.
MEMBER = (1 << 24) - 1
ARC_ROWS = "url string, ip string, date string, content_type string, page_id bigint, http string, payload binary, payload_bytes bigint, digest string"
WARC_ROWS = "record_type string, record_id string, refers_to_id string, target_uri string, date string, page_id bigint, payload_bytes bigint, payload_digest string"
_PAGE = re.compile(r"^X-Page-Id: (-?\d+)\r?$", re.M)
_LENGTH = re.compile(r"^Content-Length: (\d+)\r?$", re.M)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same page and payload give the same identifier, whoever makes it and however often."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"urn:page:{page_id}:sha1:{digest}").urn


def iso_date(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; others are the epoch."""
    if not re.fullmatch(r"\d{8,14}", arc_date):
        return "1970-01-01T00:00:00Z"
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _no_space(text: str | None) -> str:
    """A URL fit for a record line: white space and controls are percent-encoded, nothing is a hyphen."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text or "") or "-"


def member(record: bytes) -> bytes:
    """A record as gzip members - one, unless it is longer than MEMBER - without the zero byte that the last one ends with."""
    cuts = range(0, max(1, len(record)), MEMBER)
    return b"".join(gzip.compress(record[i : i + MEMBER], 6, mtime=0) for i in cuts)[:-1]


def _write(records: DataFrame, path: str) -> None:
    """Write the rows of one binary column as archives: the bytes as they are, each followed by the zero byte that ``member`` left out."""
    records.select(F.col(records.columns[0]).cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def version_block(version: int) -> bytes:
    body = f"{version} 0 {SOFTWARE}\n{FIELDS[version]}\n"
    more = "" if version == 1 else " 200 - - 0 pages.arc"
    return f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain{more} {len(body)}\n{body}\n".encode()


def arc_record(version: int, url: str, date: str, page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    more = "" if version == 1 else f" 200 {hashlib.md5(payload).hexdigest()} - 0 pages.arc"
    return f"{_no_space(url)} 0.0.0.0 {date} text/html{more} {len(body) + len(payload)}\n{body}".encode() + payload + b"\n"


def write_arc(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` (page_id, url, html): one file for each task, of version 1 and 2 in turn; html may be text or bytes."""

    def run(batches):
        version = 1 + TaskContext.get().partitionId() % 2
        first = [member(version_block(version))]
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            made = [member(arc_record(version, url, "19960101000000", page_id, html or b"")) for page_id, url, html in rows]
            yield pa.RecordBatch.from_arrays([pa.array(first + made, pa.binary())], ["value"])
            first = []

    rows = in_small_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write(rows.mapInArrow(run, "value binary"), path)


def arc_records(stream):
    """(fields, body) of each record of an ARC stream, the version block left out: lines by version, bodies by declared length."""
    names: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        line = line.decode("utf-8", "replace").rstrip("\r\n")
        if line.startswith("filedesc:"):
            body = stream.read(int(line.rsplit(" ", 1)[1])).decode()
            version = int(body.split(" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = body.split("\n")[1].split(" ")
            continue
        if not names:
            raise ValueError("an ARC file starts with its version block")
        fields = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))
        body = stream.read(length := int(fields["Archive-length"]))
        if len(body) != length:
            raise ValueError(f"an ARC record of {length} bytes ends after {len(body)}")
        yield fields, body


def _files(spark: SparkSession, path: str) -> DataFrame:
    # a folder that an empty table left has no data files, and then no rows
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")


def _batches(rows, schema: pa.Schema, most_bytes: int = 4 << 20):
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= most_bytes or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the ARC files of a folder, as ARC_ROWS; without their payloads on request."""
    schema = _schema(ARC_ROWS)

    def rows(content: bytes):
        for f, body in arc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
            http, _, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
            http = http.decode("latin-1")
            page = _PAGE.search(http)
            shown = payload if payloads else None
            yield (f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], int(page[1]) if page else None, http, shown, len(payload), base32_sha1(payload)), len(payload) * payloads

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                yield from _batches(rows(content.as_py()), schema)

    return _files(spark, path).mapInArrow(run, ARC_ROWS)


def warc_record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Write the ARC files of one folder as WARC files of another.

    Of records with equal payloads of ``least_bytes`` or more, the one with the least
    page_id is a response, the others are revisits that refer to it; all records of that
    page_id with that payload are responses. A record without a page_id comes after all
    others. Records that aren't HTTP are resources. The archives are parsed once: what is
    read is written as a table, from which digests and records are taken.
    """
    rows = cut(read_arc(spark, arc_path), "arc_records")
    same = cut(rows.where(f"http <> '' and payload_bytes >= {least_bytes}").groupBy("digest", "page_id").count(), "digests")
    first = same.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    # one row for each page that repeats another's payload; written, so that its size decides how it is joined
    later = same.join(first, "digest").where("not (page_id <=> first)").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    later = cut(later, "revisits")
    marked = rows.join(later, rows["page_id"].eqNullSafe(later["_page"]) & (rows["digest"] == later["_digest"]), "left").drop("_page", "_digest")

    def run(batches):
        info = [member(warc_record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo:{TaskContext.get().partitionId()}').urn}>", "WARC-Date": iso_date("19960101"), "Content-Type": "application/warc-fields"}, f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()))]
        for b in batches:
            out = []
            for r in b.to_pylist():
                kind = "resource" if not r["http"] else "revisit" if r["first"] is not None else "response"
                headers = {"WARC-Record-ID": f"<{record_id(r['page_id'], r['digest'])}>", "WARC-Date": iso_date(r["date"]), "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha1:{r['digest']}"}
                if kind == "resource":
                    out.append(member(warc_record(kind, headers | {"Content-Type": r["content_type"]}, r["payload"])))
                    continue
                block = r["http"].encode("latin-1") + b"\r\n\r\n" + (r["payload"] if kind == "response" else b"")
                headers["Content-Type"] = "application/http; msgtype=response"
                headers["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
                if kind == "revisit":
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    headers["WARC-Refers-To"] = f"<{record_id(r['first'], r['digest'])}>"
                out.append(member(warc_record(kind, headers, block)))
            yield pa.RecordBatch.from_arrays([pa.array(info + out, pa.binary())], ["value"])
            info = []

    _write(in_small_batches(marked).mapInArrow(run, "value binary"), warc_path)
    forget(rows, same, later)


def warc_records(stream):
    """(headers, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:20]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a WARC record of {length} bytes ends after {len(block)}")
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files of a folder but warcinfo, as WARC_ROWS; a response's payload is held against its digest."""
    schema = _schema(WARC_ROWS)

    def rows(content: bytes):
        for h, block in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
            kind = h["WARC-Type"]
            if kind == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
            http = http.decode("latin-1")
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind != "revisit" and base32_sha1(payload) != digest:
                raise ValueError(f"the payload of {h['WARC-Record-ID']} isn't that of its digest")
            page, length = _PAGE.search(http), _LENGTH.search(http)
            size = int(length[1]) if kind == "revisit" and length else len(payload)
            yield (kind, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"), int(page[1]) if page else None, size, digest), 0

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                yield from _batches(rows(content.as_py()), schema)

    return _files(spark, path).mapInArrow(run, WARC_ROWS)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row for each row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The pages go into ARC files, these into WARC files, and those are read back. A null
    html is an empty payload, a null url a hyphen; rows without a page_id are never referred
    to. Repeated rows of the least page_id of a payload are all responses. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes)
    found = cut(read_warc(spark, warc), "records")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    known = found.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("record_id", "_id")
    # only revisits look for the record that they refer to
    revisits = found.where("record_type = 'revisit'").join(known, F.col("refers_to_id") == F.col("_id"), "left").select(*columns, "refers_to")
    return found.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits)


def oracle() -> str:
    """The same rows in DuckDB SQL; base 32 is spelled from the digest's 160 bits, five at a time."""
    bits = "('0x' || substr(hex, {0}, 5))::BIGINT"
    # five hex digits are four characters of five bits
    groups = " || ".join(
        "".join(f"{' || ' if j else ''}substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({bits.format(5 * i + 1)} >> {15 - 5 * j}) & 31)::INTEGER, 1)" for j in range(4)) for i in range(8)
    )
    return f"""
    WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    digests AS (SELECT page_id, payload_bytes, {groups} AS payload_digest FROM payloads),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM digests)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
      CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
    FROM firsts"""
