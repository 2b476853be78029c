"""Converter from legacy ARC archives to WARC.

ARC: a file starts with a version block (``filedesc://``) whose second line
names the version.  Version 1 header lines have five fields (URL, IP address,
date, content type, length), version 2 lines ten (URL, IP address, date,
content type, result code, checksum, location, offset, file name, length).  A
record is its header line, as many bytes as the line declares, and a line feed.
URLs may hold spaces, so fields are counted from the right.

WARC: each ARC record becomes a record with an identifier (a name-based UUID
of its place, URL and date), an ISO timestamp, a type, and SHA-1 digests in
base32 of block and payload.  The version block becomes ``warcinfo``; HTTP
messages become ``response``; anything else ``resource``.  Of HTTP records
with equal payloads of at least ``least`` bytes, the one with the smallest key
stays ``response``, the others become ``revisit`` records that refer to it and
keep only the HTTP head.

Files are written by Spark's text sink with the record separator as line
separator, gzip-compressed, so the commit protocol of the sink covers lost
executors, and are read as whole binary files, one stream per file.  Payloads
pass through one join (with the revisits) and are never grouped.

Defined cases.  A null or empty page has an empty payload; a null URL is
written as ``-``; control characters and spaces of URLs are percent-encoded.  A
null page_id is kept as null and ranks after all others.  Of repeated rows with
equal payload exactly one is the response.  A header line that does not parse
is skipped up to the next one that does; a body shorter than declared is kept
and marked ``truncated``.  Dates of fewer than 14 digits are filled up; dates
that are none become 1970-01-01T00:00:00Z.  An empty table gives an empty
result.
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

from lexeval.llm.common import shared_path, stage

#: Fields of a header line by ARC version, as the version block names them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORDS = ("rid string, arc_version int, url string, ip string, date string, mime string, truncated boolean, kind string, "
           "page_id long, payload_bytes long, payload_digest string, block_digest string")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url) if url else "-"


def iso_date(digits: str) -> str:
    """14-digit date, or the start of one, as ISO 8601."""
    filled = digits + "00000101000000"[len(digits):]
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", filled)
    ok = m and "01" <= m[2] <= "12" and "01" <= m[3] <= "31" and m[4] <= "23" and m[5] <= "59" and m[6] <= "60"
    return "{}-{}-{}T{}:{}:{}Z".format(*m.groups()) if ok else "1970-01-01T00:00:00Z"


def http_parts(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Head fields and payload of an HTTP message; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    head, found, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload if found else b""


# --- ARC ---------------------------------------------------------------------------------------

def arc_header(line: str, version: int) -> dict | None:
    """Fields of a header line counted from the right, or None."""
    names = FIELDS[version].split()
    parts = line.rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        return None
    return dict(zip(names, parts))


def _version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    if version == 1:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}"
    else:
        head = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"
    return head.encode() + b"\n" + body


def write_arc(pages: DataFrame, path: str, date: str = "20010203040506") -> None:
    """``pages(page_id, url, html)`` as ARC files below ``path``, one a
    partition, of version 1 and 2 in turn.  Each record is an HTTP response
    that carries page_id in its head."""
    def run(batches):
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        version, name, offset = 1 + part % 2, f"pages-{part:05d}.arc.gz", 0
        for batch in batches:
            out = []
            if not offset:
                out.append(_version_block(version, name, date))
                offset = len(out[0]) + 1
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                key = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{key}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                head = f"{plain_url(url)} 0.0.0.0 {date} text/html "
                if version == 2:
                    head += f"200 {sha1(payload)} - {offset} {name} "
                out.append(f"{head}{len(block)}".encode() + b"\n" + block)
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option(
        "compression", "gzip").text(path)


def _stream(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def parse_arc(content: bytes, name: str):
    """Records of an ARC file, the version block first."""
    stream, version, offset, number = _stream(content), 1, 0, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        if not text:
            continue
        block = None
        if text.startswith("filedesc://"):
            length = int(text.rsplit(" ", 1)[-1]) if text.rsplit(" ", 1)[-1].isdigit() else 0
            block = stream.read(length)
            offset += len(block)
            version = 2 if block.startswith(b"2") else 1
        fields = arc_header(text, version)
        if fields is None:
            continue
        length = int(fields["Archive-length"])
        if block is None:
            block = stream.read(length)
            offset += len(block)
        digits = fields["Archive-date"]
        rid = uuid.uuid5(_SPACE, f"{name} {start} {fields['URL']} {digits}")
        yield {"rid": str(rid), "arc_version": version, "url": fields["URL"].encode("utf-8", "replace").decode(), "ip": fields["IP-address"],
               "date": iso_date(digits), "mime": fields["Content-type"], "truncated": len(block) < length, "block": block}
        number += 1


def _arc_rows(with_block: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["block"] * with_block
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORDS.split(", "))] + [("block", pa.binary())] * with_block)

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for r in parse_arc(content, path.rsplit("/", 1)[-1]):
                    block = r["block"]
                    parts = http_parts(block)
                    head, payload = parts if parts else ({}, block)
                    page = head.get("x-page-id", "")
                    r |= {"kind": "warcinfo" if r["url"].startswith("filedesc://") else "response" if parts else "resource",
                          "page_id": int(page) if re.fullmatch(r"-?\d+", page) else None, "payload_bytes": len(payload),
                          "payload_digest": sha1(payload), "block_digest": sha1(block)}
                    rows.append({n: r[n] for n in names})
                    size += len(block) if with_block else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records of all ARC files below ``path``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(_arc_rows(with_block), RECORDS + (", block binary" if with_block else ""))


# --- WARC --------------------------------------------------------------------------------------

def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(rid, first_rid, first_url, first_date) of the HTTP records whose payload
    a record with a smaller key has as well."""
    http = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("rid").alias("rid"),
                    F.col("url").alias("url"), F.col("date").alias("date"))
    first = http.groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (http.select("rid", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"])
            .where(F.col("rid") != F.col("first.rid"))
            .select("rid", F.col("first.rid").alias("first_rid"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")))


def warc_record(r: dict) -> bytes:
    """One WARC record without the closing separator."""
    block, kind = r["block"], r["kind"]
    payload = None
    fields = [("WARC-Type", "revisit" if r["first_rid"] else kind), ("WARC-Record-ID", f"<urn:uuid:{r['rid']}>"), ("WARC-Date", r["date"])]
    if kind != "warcinfo":
        fields.append(("WARC-Target-URI", r["url"]))
        fields.append(("WARC-IP-Address", r["ip"]))
        payload = r["payload_digest"]
    if r["first_rid"]:
        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
        fields += [("WARC-Refers-To", f"<urn:uuid:{r['first_rid']}>"), ("WARC-Refers-To-Target-URI", r["first_url"]),
                   ("WARC-Refers-To-Date", r["first_date"]), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
    elif r["truncated"]:
        fields.append(("WARC-Truncated", "unspecified"))
    fields.append(("WARC-Block-Digest", "sha1:" + (sha1(block) if r["first_rid"] else r["block_digest"])))
    if payload:
        fields.append(("WARC-Payload-Digest", "sha1:" + payload))
    kinds = {"response": "application/http; msgtype=response", "warcinfo": "application/warc-fields"}
    fields += [("Content-Type", kinds.get(kind, r["mime"])), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block


def write_warc(records: DataFrame, path: str, least: int = 0) -> None:
    """ARC records (:func:`read_arc`, with blocks) as WARC files below ``path``."""
    light = stage(records.drop("block").where("kind = 'response'"), "arc-records")
    again = stage(revisits(light, least), "revisits")

    def run(batches):
        for batch in batches:
            out = [warc_record(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = records.join(again, "rid", "left").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(content: bytes):
    """(fields, block) of each record of a WARC file."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


WARC = ("record_id string, record_type string, target_uri string, date string, refers_to_id string, page_id long, "
        "payload_bytes long, payload_digest string, digest_ok boolean")


def _warc_rows(batches):
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in WARC.split(", ")])
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for f, block in parse_warc(content):
                head, payload = http_parts(block) or ({}, block)
                given = f.get("warc-payload-digest", "").removeprefix("sha1:")
                revisit = f.get("warc-type") == "revisit"
                page, length = head.get("x-page-id", ""), head.get("content-length", "")
                rows.append({"record_id": f.get("warc-record-id"), "record_type": f.get("warc-type"), "target_uri": f.get("warc-target-uri"),
                             "date": f.get("warc-date"), "refers_to_id": f.get("warc-refers-to"),
                             "page_id": int(page) if re.fullmatch(r"-?\d+", page) else None,
                             "payload_bytes": int(length) if revisit and length.isdigit() else len(payload),
                             "payload_digest": given if revisit else sha1(payload),
                             "digest_ok": f.get("warc-block-digest") == "sha1:" + sha1(block) and (revisit or given in ("", sha1(payload)))})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below ``path``: identity, type, the payload's
    length and digest (as declared where the payload is left out)."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(_warc_rows, WARC)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """ARC files below ``arc_path`` to WARC files below ``warc_path``."""
    write_warc(read_arc(spark, arc_path), warc_path, least)


def pages_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` to ARC, ARC to WARC, and the WARC files read back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to, digest_ok)."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    back = stage(read_warc(spark, warc).where("record_type in ('response', 'revisit')"), "warc-records")
    target = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    target = target.join(back.where("refers_to_id is not null").select("refers_to_id").distinct(), "refers_to_id")
    return back.join(target, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
