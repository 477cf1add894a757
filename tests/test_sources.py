"""Routing rows, size policy, listings, profiles, sinks and reports."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.operators import report as RP
from leakscope.operators.ess import ess, scan_summary
from leakscope.plans import scans as P
from leakscope.sources import channels as CH
from leakscope.sources import files as FL
from leakscope.sources import pastes as PA
from leakscope.sources import sinks as SK
from leakscope.sources import social as SO

ROUTES = [("src/app.py", 10, "text"), (".env", 10, "skip"), ("conf/prod.env", 10, "text"), (".env.local", 10, "skip"), ("docs/scan.PDF", 10, "ocr"),
          ("a.py", 1000001, "skip"), ("Node_Modules/x/a.js", 10, None), ("build", 10, "skip"), ("a/public/b.md", 10, None), ("x.", 1, "skip")]


def test_routes(spark):
    df = spark.createDataFrame([("r", "main", p, "blob", s) for p, s, _ in ROUTES], schemas.FILES)
    got = {r.path: r.route for r in FL.classify_route(FL.filter_tree(df), 1_000_000).collect()}
    assert got == {p: r for p, _s, r in ROUTES if r is not None}
    every = {r.path: r.route for r in FL.classify_route(FL.filter_tree(df)).collect()}
    assert every == got | {"a.py": "text"}


def test_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\xfe caf\xc3\xa9")
    (tmp_path / "b.txt").write_bytes("é".encode() * 10)
    docs = {r.path[-5:]: r.text for r in FL.read_documents(spark, str(tmp_path), "binary").collect()}
    assert docs["a.txt"] == b"ok \xff\xfe caf\xc3\xa9".decode("utf-8", "replace") and docs["b.txt"] == "é" * 10
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert FL.apply_size_policy(raw, "repo", limit=12).count() == 1
    cut = {r.path[-5:]: r.text for r in FL.apply_size_policy(raw, "paste", limit=5).collect()}
    assert cut["b.txt"] == ("é" * 10).encode()[:5].decode("utf-8", "replace")
    with pytest.raises(ValueError):
        FL.apply_size_policy(raw, "mail")


def test_paste_pages(spark):
    html = ("<a href='/archive'>x</a><a class=k href=\"/AbCd1234?source=archive\">One &amp; <b>two</b></a><a href='/AbCd1234'>again</a>"
            "<a href='/archive/python'>p</a><a href='/zzzzzzzz'></a><a name='n'>no</a><a href='/toolong99'>t</a>")
    old = "<table class='maintable'><tr><th>h</th></tr><tr><td>no link</td></tr></table>"
    out = PA.paste_links(spark.createDataFrame([(1, "u", html), (2, "u", old)], schemas.PASTE_INDEX_PAGES), 10).collect()
    assert [(r.page_id, r.paste_id, r.title) for r in out] == [(1, "AbCd1234", "One & two"), (1, "zzzzzzzz", "Untitled")]
    demo = PA.demo_pastes(spark)
    empty = demo.limit(0)
    assert PA.recent_pastes(empty, empty, demo, 3).count() == 3
    body = json.dumps([{"key": "a", "size": "12"}, {"key": ""}, {"title": "t"}, {"key": "b", "title": "T", "size": "x"}])
    got = PA.pastes_from_json(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.paste_id, r.title, r.syntax, r.size, r.expire) for r in got] == [("a", "Untitled", "text", 12, "0"), ("b", "T", "text", 0, "0")]


def listing(*items):
    return json.dumps({"data": {"children": [{"data": i} for i in items]}})


def test_forum(spark):
    about = json.dumps({"data": {"subreddit": {"public_description": " hi ", "display_name_prefixed": "u/x"}}})
    posts = listing({"id": "p1", "title": "T", "selftext": "S", "permalink": "/p1"}, {"id": "p2", "title": "", "selftext": ""}, {"title": "U"})
    talk = listing({"id": "c1", "body": "one"}, {"id": "c2", "body": "[deleted]"}, {"id": "c3", "body": "three"})
    df = spark.createDataFrame([("u/x", "about", about), ("x", "submitted", posts), ("x", "comments", talk), ("ghost", "comments", talk)], schemas.FORUM_JSON)
    ids = lambda n, b="clamp": [r.post_id for r in SO.forum_documents(df, n, b).orderBy("part", "page", "position").collect()]
    assert ids(10) == ["x_bio", "p1", "unknown", "c1", "c3"]
    assert ids(4) == ["x_bio", "p1", "unknown", "c1"]
    assert ids(1) == ["x_bio", "p1"] and ids(1, "as_is") == ["x_bio", "p1"]
    assert ids(3, "as_is") == ["x_bio", "p1", "unknown"]
    first = SO.forum_documents(df, 10).filter("content_type = 'bio'").first()
    assert first.content == "hi | u/x"
    with pytest.raises(ValueError):
        SO.social_documents("myspace", df)


def test_channels_and_images(spark):
    msgs = spark.createDataFrame([("@c", i, None if i == 3 else f"m{i}", None, None) for i in range(1, 6)] + [(" ", 9, "x", None, None)], schemas.CHANNEL_MESSAGES)
    got = [r.url for r in CH.channel_documents(msgs, 3).orderBy("message_id").collect()]
    assert got == ["https://t.me/c/4", "https://t.me/c/5"]
    texts = spark.createDataFrame([("s", None, "f", "Government of India x"), ("t", None, "f", "plain"), ("e", None, "f", "")], schemas.OCR_TEXTS)
    rows = {r.source_url: r for r in CH.ocr_documents(texts).collect()}
    assert set(rows) == {"s_ocr", "t_ocr"} and rows["s_ocr"].text.startswith("[KYC_DOCUMENT_DETECTED]\nGov") and rows["s_ocr"].metadata["is_kyc"] == "true"

    def reader(frames):
        for f in frames:
            yield f.assign(text=[bytes(c).decode() for c in f["content"]])[["path", "text"]]

    binaries = spark.createDataFrame([("p", b"abc")], "path string, content binary")
    assert CH.extract_texts(binaries, reader).first().text == "abc"


def test_profiles(spark):
    profiles = spark.createDataFrame([
        ("u1", [("Email", "", " a1@b.co "), ("github", "Main", "https://github.com/own/"), ("telegram", "ch", "@chan"), ("website", "w", "http://x.io/?q=ABCPE1234F")], None, None),
        ("u2", [("reddit", "r", "nobody")], None, None)], schemas.PROFILES)
    repos = spark.createDataFrame([("own", "own/r1", "r1", "", "dev", 1, False, None), ("own", "own/r2", "r2", "", None, 1, True, None)], schemas.REPOS)
    files = spark.createDataFrame([("own/r1", "dev", "a.py", "blob", 10), ("own/r1", "dev", "yarn.lock", "blob", 10)], schemas.FILES)
    contents = spark.createDataFrame([("own/r1", "dev", "a.py", "ssn 123-45-6789")], "repo string, branch string, path string, text string")
    forum = spark.createDataFrame([], schemas.FORUM_JSON)
    msgs = spark.createDataFrame([("chan", 5, "call 9876543210", None, None)], schemas.CHANNEL_MESSAGES)
    out = P.scan_profiles(profiles, repos, files, contents, forum, msgs).stored()
    got = sorted((r.scan_id, r.type, r.platform, r.source, r.source_url) for r in out.findings.collect())
    assert got == [
        ("u1", "EMAIL", "email", "Email (email): a1@b.co", ""), ("u1", "PAN", "website", "Website (w): http://x.io/?q=ABCPE1234F", "http://x.io/?q=ABCPE1234F"),
        ("u1", "PHONE", "telegram", "Telegram (ch): chan", "https://t.me/chan/5"),
        ("u1", "SSN", "github", "GitHub (Main): own/r1/a.py", "https://github.com/own/r1/blob/dev/a.py")]
    summary = {r.scan_id: r for r in out.summary.collect()}
    assert summary["u1"].total_sources == 4 and summary["u2"].label == "NONE" and summary["u2"].max_ess == 0.0
    assert {r.scan_id: r.total_sources_scanned for r in out.scanned.collect()} == {"u1": 4, "u2": 1}


def test_store_and_report(spark, tmp_path):
    docs = spark.createDataFrame([("s1", i, "src", f"http://x/{i}", f"my pan ABCPE{1000 + i}F <b>") for i in range(25)] + [("s2", 99, "src", "", "clean")],
                                 "scan_id string, doc_id long, source string, source_url string, text string")
    from leakscope.operators.detect import scan

    found = scan(docs, filename=None, masked=True).withColumn("source_type", F.lit("pastebin"))
    scored = ess(found, ["scan_id", "doc_id"])
    other = found.withColumn("scan_id", F.lit("s0"))
    for _ in range(2):
        SK.write_scan(found, scored, str(tmp_path / "db"), "2024-05-01")
        SK.write_scan(other, ess(other, ["scan_id", "doc_id"]), str(tmp_path / "db"), "2024-05-01")
    assert {r.scan_id: r["count"] for t in ("leak_records", "ess_records") for r in spark.read.parquet(str(tmp_path / "db" / t)).groupBy("scan_id").count().collect()} == {"s0": 25, "s1": 25}
    leaks = spark.read.parquet(str(tmp_path / "db/leak_records"))
    assert leaks.count() == 50 and "value" not in leaks.columns and leaks.filter(F.col("snippet").rlike("ABCPE[0-9]{4}F")).count() == 0
    scans = spark.createDataFrame([("s1", "o <1>", "pastebin", 25, 2.0), ("s2", "clean", "github", 1, 0.0)], "scan_id string, target string, scan_type string, files_scanned int, scan_duration double")
    parts = RP.report_fragments(found, scored, scan_summary(scored), scans)
    SK.write_report(parts, str(tmp_path / "report"))
    SK.write_report(parts.filter("scan_id = 's2'"), str(tmp_path / "report"))  # leaves the other one
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "report/scan_id=s1/*.txt"))))
    assert text.startswith("<!DOCTYPE html>") and text.rstrip().endswith("</html>") and "o &lt;1&gt;" in text
    numbers = [int(x.split("</td>")[0]) for x in text.split("<tr><td>")[1:]]
    assert numbers == list(range(1, 26))
    clean = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "report/scan_id=s2/*.txt"))))
    assert "no identifiers, no action needed" in clean and "This scan came back empty." in clean
    SK.append_history(spark.createDataFrame([("u", 1)], "user_email string, findings_count int"), str(tmp_path / "h"))
    SK.append_history(spark.createDataFrame([("u", 2)], "user_email string, findings_count int"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).filter("created_at is not null").count() == 2
    for batch in ("a", "b", "a"):
        SK.append_history(spark.createDataFrame([("u", "r1", 1), ("u", "r2", 2)], "user_email string, target string, findings_count int"), str(tmp_path / "h2"), batch)
    kept = spark.read.parquet(str(tmp_path / "h2"))
    assert kept.count() == kept.select("id").distinct().count() == 4


def test_no_value_in_a_masked_snippet(spark):
    from leakscope.operators.detect import scan

    text = "my aadhaar 2345\n6789\n0124 and pan ABCPE1234F phone 9876543210 " + "pan ABCPE1234F, " * 30
    df = spark.createDataFrame([(1, text), (2, "x" * 60 + " 9876543210 " + "y" * 90)], "doc_id long, text string")
    for how in ({}, {"chunk_size": 150, "overlap": 120}):
        rows = scan(df, filename=None, masked=True, **how).collect()
        assert len(rows) == 34
        for r in rows:
            assert not any(v in r.masked_snippet for v in ("2345 6789 0124", "2345\n6789", "ABCPE1234F", "9876543210"))
            assert r.value_masked.replace("\n", " ") in r.masked_snippet
    assert SK.leak_records(scan(df, filename=None)).filter("snippet is not null").count() == 0
