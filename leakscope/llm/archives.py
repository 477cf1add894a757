"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

Archives are files in a shared folder, written and read by Spark's text and binary sources. An archive is cut after some MB, so
one file fits a task. A record that is lost by a task is written again by its retry, under the same commit protocol as Parquet.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.common import shared_path, stored

ARCHIVE_BYTES = 8 << 20
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
# The field names that the two versions of the format declare.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
DATE = "20240101000000"
ARCHIVED = "archive string, seq long, record binary"
PARSED = "page_id long, url string, ip string, date string, http binary, payload binary, digest string"
READ = "record_id string, record_type string, refers_id string, page_id long, payload_bytes long, payload_digest string"


# ---------------------------------------------------------------- files

def _in_archives(record: Callable[[dict], bytes], opening: Callable[[str], bytes], columns: list[str]):
    """Rows to records, numbered within archives of about ARCHIVE_BYTES; each archive begins with its opening record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, seq, size, name = TaskContext.get().partitionId(), -1, 0, ARCHIVE_BYTES, ""
        for batch in batches:
            out: dict[str, list] = {"archive": [], "seq": [], "record": []}
            for row in zip(*(batch.column(c) for c in columns), strict=True):
                if size >= ARCHIVE_BYTES:
                    archive, seq, size = archive + 1, 0, 0
                    name = f"{part:06d}-{archive:06d}"
                    for key, x in zip(out, (name, 0, opening(name)), strict=True):
                        out[key].append(x)
                raw = record(dict(zip(columns, (x.as_py() for x in row), strict=True)) | {"archive": name})
                seq, size = seq + 1, size + len(raw)
                for key, x in zip(out, (name, seq, raw), strict=True):
                    out[key].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("record", pa.binary())]))

    return run


def _write(records: DataFrame, path: str, end: str) -> None:
    """One gzip file per archive, its records in order, `end` behind each."""
    rows = records.sortWithinPartitions("archive", "seq").select("archive", F.col("record").cast("string").alias("value"))
    rows.write.partitionBy("archive").option("lineSep", end).option("compression", "gzip").text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def _unpacked(content: bytes) -> bytes:
    return zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content


# ---------------------------------------------------------------- ARC

def _arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, archive: str) -> bytes:
    middle = [] if version == 1 else ["200", "-", "-", "0", archive]
    return " ".join([url, ip, date, kind, *middle, str(length)]).encode()


def arc_opening(version: int, archive: str) -> bytes:
    """The version block: it names the version and the fields of the header lines that follow."""
    block = f"{version} 0 leakscope\n{FIELDS[version]}\n".encode()
    return _arc_header(version, f"filedesc://{archive}.arc", "0.0.0.0", DATE, "text/plain", len(block), archive) + b"\n" + block


def arc_record(version: int, row: dict) -> bytes:
    payload = (row["html"] or "").encode()
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", row["url"] or "") or "-"
    page = "" if row["page_id"] is None else row["page_id"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page}\r\n\r\n".encode()
    return _arc_header(version, url, "0.0.0.0", DATE, "text/html", len(http) + len(payload), row["archive"]) + b"\n" + http + payload


def write_arc(pages: DataFrame, path: str, version: int) -> None:
    """A page per record; null html is an empty payload, a null url is written as '-'."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    make = _in_archives(lambda row: arc_record(version, row), lambda name: arc_opening(version, name), ["page_id", "url", "html"])
    _write(rows.mapInArrow(make, ARCHIVED), path, "\n")


def parse_arc(raw: bytes) -> Iterator[dict[str, bytes]]:
    """The records of an archive behind its version block, by field name, with the content under ''. The block says which
    fields a header line has; the last is always the length of the content."""
    fields, at = None, 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        line = raw[at:end].rstrip(b"\r")
        if not line:  # the newline behind a record
            at = end + 1
            continue
        values = line.split(b" ")
        length = int(values[-1])
        content = raw[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError("an ARC record is shorter than its header says")
        at = end + 1 + length
        if line.startswith(b"filedesc://"):
            first, names = content.split(b"\n")[:2]
            version = int(first.split(b" ")[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = names.decode().split()
            continue
        if fields is None:
            raise ValueError("an ARC file must begin with its version block")
        extra = len(values) - len(fields)  # blanks in a URL that was not encoded
        values = [b" ".join(values[: extra + 1]), *values[extra + 1 :]]
        yield dict(zip(fields, values, strict=True)) | {"": content}


def _http_parts(content: bytes) -> tuple[bytes, bytes]:
    head, mark, body = content.partition(b"\r\n\r\n")
    return (head + mark, body) if mark and head.startswith(b"HTTP/") else (b"", content)


def _http_field(http: bytes, name: str) -> str:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", http)
    return m[1].decode() if m else ""


def _number(text: str) -> int | None:
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def _arc_rows(with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("digest", pa.string())])
        for batch in batches:
            for content in batch.column("content"):
                out: dict[str, list] = {n: [] for n in schema.names}
                for r in parse_arc(_unpacked(content.as_py())):
                    http, body = _http_parts(r[""])
                    sized = body if with_content else len(body).to_bytes(8, "big")
                    for key, x in zip(out, (_number(_http_field(http, "X-Page-Id")), r["URL"].decode(), r["IP-address"].decode(), r["Archive-date"].decode(), http, sized, hashlib.sha1(body).hexdigest()), strict=True):
                        out[key].append(x)
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def read_arc(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """The records of all archives below a path. Without content, payload holds the length in eight bytes."""
    return _contents(spark, path).mapInArrow(_arc_rows(with_content), PARSED)


# ---------------------------------------------------------------- WARC

def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def warc_opening(archive: str) -> bytes:
    name = f"{archive}.warc"
    return _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", _iso(DATE)), ("WARC-Filename", name),
                  ("Content-Type", "application/warc-fields")], b"software: leakscope\r\nformat: WARC File Format 1.0\r\n")


def warc_record(row: dict) -> bytes:
    """What corresponds to an ARC record: identifier by page and digest, date in ISO form, type, and digests of block and payload.
    A revisit has the HTTP header alone, and names the record that holds its payload."""
    revisit = row["refers_page"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["page_id"], row["digest"])), ("WARC-Date", _iso(row["date"])),
        ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()),
    ]
    if revisit:
        fields += [("WARC-Refers-To", record_id(row["refers_page"], row["digest"])), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    return _warc(fields, row["http"] if revisit else row["http"] + row["payload"])


def convert_arc(spark: SparkSession, arc_paths: list[str], warc_path: str, least: int = REVISIT_BYTES) -> None:
    """All archives below some paths to WARC. Of records with equal payloads of at least `least` bytes, the one with the largest
    page_id is the response and the others revisit it; a record without page_id is always a response.

    Only digests are grouped. Payloads move if the table of repeated digests is too large to be broadcast by its known size.
    """
    def parsed(content: bool) -> DataFrame:
        frames = [read_arc(spark, p, content) for p in arc_paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    sized = parsed(False).filter(F.conv(F.hex("payload"), 16, 10).cast("long") >= least).select("page_id", "digest")
    best = sized.groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1 and best is not null").select("digest", "best")
    best = stored(best, "repeated")
    rows = parsed(True).join(best, "digest", "left").withColumn("refers_page", F.when(F.col("page_id") != F.col("best"), F.col("best")))
    columns = ["page_id", "url", "ip", "date", "http", "payload", "digest", "refers_page"]
    _write(rows.select(*columns).mapInArrow(_in_archives(warc_record, warc_opening, columns), ARCHIVED), warc_path, "\r\n\r\n")


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of every record."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + length]
        if len(block) != length or fields.get("warc-block-digest", _sha1(block)) != _sha1(block):
            raise ValueError("a WARC record doesn't hold what its header says")
        at = end + 8 + length
        yield fields, block


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in batches:
        for content in batch.column("content"):
            out: dict[str, list] = {n: [] for n in schema.names}
            for fields, block in parse_warc(_unpacked(content.as_py())):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, body = _http_parts(block)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError("a payload doesn't have its digest")
                size = len(body) if kind == "response" else _number(_http_field(http, "Content-Length"))
                for key, x in zip(out, (fields["warc-record-id"], kind, fields.get("warc-refers-to"), _number(_http_field(http, "X-Page-Id")), size, digest), strict=True):
                    out[key].append(x)
            yield pa.RecordBatch.from_pydict(out, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers_id, page_id, payload_bytes and payload_digest of the responses and revisits below a path."""
    return _contents(spark, path).mapInArrow(_warc_rows, READ)


def through_archives(pages: DataFrame) -> DataFrame:
    """Pages to ARC (half of them version 1, half version 2), from there to WARC, and back: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response that a revisit names).

    Null html is an empty payload. Rows that repeat a page_id each get a record; those with the largest page_id of their payload
    are all responses. An empty table gives no rows. Other columns are not archived.
    """
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "archives")
    odd = F.pmod(F.xxhash64("page_id"), F.lit(2))
    for version in (1, 2):
        write_arc(pages.filter(odd == version - 1), f"{path}/arc{version}", version)
    convert_arc(spark, [f"{path}/arc1", f"{path}/arc2"], f"{path}/warc")
    read = read_warc(spark, f"{path}/warc")
    target = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("page_id").alias("refers_to"))
    return read.join(target, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
