import hashlib
import zlib

import pytest

from leakscope.llm import archives
from leakscope.llm.archives import arc_opening, arc_record, parse_arc, parse_warc, read_arc, through_archives, warc_opening, warc_record, write_arc
from leakscope.llm.common import shared_path

PAGES = "page_id long, url string, html string, digest string, record int"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_of_both_versions(version):
    rows = [{"page_id": 7, "url": "http://x/a b", "html": "é\r\n\r\nfiledesc://no", "archive": "n"}, {"page_id": None, "url": None, "html": None, "archive": "n"}]
    raw = arc_opening(version, "n") + b"\n" + b"".join(arc_record(version, r) + b"\n" for r in rows)
    first, second = parse_arc(raw)
    assert first["URL"] == b"http://x/a%20b" and first[""].endswith("é\r\n\r\nfiledesc://no".encode()) and second["URL"] == b"-"
    assert ("Result-code" in first) == (version == 2)
    foreign = raw.replace(b"http://x/a%20b", b"http://x/a b")  # blanks in a URL
    assert next(parse_arc(foreign))["URL"] == b"http://x/a b"
    for broken in (raw[:-10], raw[raw.index(b"\n", raw.index(b"\nURL")) + 1 :], raw.replace(b"%d 0 leakscope" % version, b"9 0 leakscope")):
        with pytest.raises(ValueError):
            list(parse_arc(broken))


def test_warc_records():
    digest = hashlib.sha1(b"body").hexdigest()
    row = {"page_id": 1, "url": "http://x", "ip": "0.0.0.0", "date": "20240102030405", "http": b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n", "payload": b"body", "digest": digest, "refers_page": None}
    raw = b"".join(r + b"\r\n\r\n" for r in (warc_opening("a"), warc_record(row), warc_record(row | {"page_id": 0, "refers_page": 1})))
    info, response, revisit = parse_warc(raw)
    assert info[0]["warc-type"] == "warcinfo" and response[0]["warc-date"] == "2024-01-02T03:04:05Z" and response[1].endswith(b"body")
    assert revisit[0]["warc-refers-to"] == response[0]["warc-record-id"] and revisit[1] == row["http"]
    with pytest.raises(ValueError):
        list(parse_warc(raw.replace(b"body", b"bodx")))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 5000)  # many small archives
    long = "long é " * 300
    rows = [(1, "u", long), (2, "u", long), (9, "u", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", long), (8, "u", "x\r\n\r\nWARC/1.0"), (7, "u", "b" * 100_000), (9, "u", long)]
    out = sorted((tuple(r) for r in through_archives(spark.createDataFrame([(*r, "d", 1) for r in rows], PAGES)).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = page_id in (1, 2)
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert out == sorted(want, key=str)
    assert through_archives(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_gzip_files_with_an_opening(spark):
    path = shared_path(spark, "arc")
    write_arc(spark.createDataFrame([(1, "http://x", "<p>", "", 0)], PAGES), path, 2)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).first().content
    assert zlib.decompress(raw, 47).startswith(b"filedesc://") and read_arc(spark, path).first().payload == b"<p>"
