"""Alert stream: batch equals stream, no repeats across batches and restarts, late rows, errors aside."""
import json
import os

from pyspark.sql import functions as F

from leakscope.operators.detect import scan
from leakscope.streaming import alerts as A


def land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    tmp = os.path.join(folder, "." + name)
    with open(tmp, "w") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
    os.rename(tmp, os.path.join(folder, name))


def doc(kind, target, text, at, path="a.txt"):
    return {"kind": kind, "target": target, "path": path, "url": "http://x/" + target, "text": text, "landed_at": at}


def test_alert_stream(spark, tmp_path):
    landing, out, ck, errs = (str(tmp_path / n) for n in ("in", "out", "ck", "err"))
    targets = A.targets_table(spark, ["r1"], True, ["c1"])

    def once():
        q = A.alert_stream(spark, landing, targets, out, ck, profile="fast", once=True, errors=errs)
        q.awaitTermination()
        for other in spark.streams.active:
            other.awaitTermination()

    land(landing, "1.json", [
        doc("github", "r1", "aadhaar 2341 2341 2346", "2024-01-01T00:00:00Z"), doc("github", "r9", "pan ABCPE1234F", "2024-01-01T00:00:10Z"),
        doc("pastebin", "p7", "pan ABCPE1234F", "2024-01-01T00:01:00Z"), doc("telegram", "c1", "aadhaar 2341 2341 2346", "2024-01-01T00:02:00Z"),
        "{broken", doc("telegram", "c1", None, "2024-01-01T00:02:00Z"),
    ])
    once()
    found = spark.read.parquet(out + "/findings")
    assert sorted((r.type, r.source) for r in found.collect()) in (
        [("AADHAAR", "github:r1"), ("PAN", "pastebin:p7")], [("AADHAAR", "telegram:c1"), ("PAN", "pastebin:p7")])
    assert "value" not in found.columns and not found.filter(F.col("snippet").contains("ABCPE1234F")).count()
    land(landing, "2.json", [doc("pastebin", "p8", "again ABCPE1234F and my ssn 123-45-6789", "2024-01-01T02:00:00Z")])
    once()
    once()
    rows = spark.read.parquet(out + "/findings").collect()
    assert sorted(r.type for r in rows) == ["AADHAAR", "PAN", "SSN"]
    alert = spark.read.parquet(out + "/alerts").orderBy("batch_id").collect()
    assert [(a.total, a.critical, a.sample_size) for a in alert if a.total] == [(2, 1, 2), (1, 1, 1)]
    bad = spark.read.json(errs).collect()
    assert sorted(r.message for r in bad) == ["Scan failed: no content", "Scan failed: unreadable record"]


def test_batch_equals_stream_windows_and_late_rows(spark, tmp_path):
    landing = str(tmp_path / "in")
    rows = [doc("github", "r", f"pan ABCPE{1000 + i}F", f"2024-01-01T00:{i:02d}:00Z", f"{i}.txt") for i in range(30)]
    land(landing, "1.json", rows)
    batch_docs = spark.read.schema(A.LANDED).json(landing)
    batch = A.alert_windows(A.tagged_findings(batch_docs, "fast"))
    found = A.tagged_findings(A.readable(A.landed_documents(spark, landing)), "fast").withWatermark("detected_at", "1 minute")

    def run_files():
        q = A.alert_windows(found).writeStream.format("parquet").option("path", str(tmp_path / "w")).outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run_files()
    land(landing, "2.json", [doc("github", "r", "pan ABCPE9999F", "2024-01-01T00:01:00Z", "late.txt"), doc("github", "r", "pan ABCPE8888F", "2024-01-01T05:00:00Z", "new.txt")])
    run_files()
    got = {(r.window_start, r.total) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got == {(r.window_start, r.total) for r in batch.collect()}


def test_scan_streams_in_every_profile(spark, tmp_path):
    landing = str(tmp_path / "in")
    land(landing, "1.json", [doc("github", "r", "my pan ABCPE1234F, mail a1@b.co", "2024-01-01T00:00:00Z")])
    docs = A.readable(A.landed_documents(spark, landing)).select("target", "text")
    static = spark.read.schema(A.LANDED).json(landing).select("target", "text")
    for profile in ("fast", "context", "extended", "strict"):
        name = "p_" + profile
        q = scan(docs, profile, filename=None).select("type", "value").writeStream.format("memory").queryName(name).trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, scan(static, profile, filename=None).select("type", "value").collect()))


def test_session_stream(spark, tmp_path):
    ev = spark.range(50).select(F.lit("t").alias("type"), F.timestamp_seconds(F.col("id") * 60 + F.when(F.col("id") > 25, 7200).otherwise(0)).alias("detected_at"))
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")).withWatermark("detected_at", "1 minute")
    q = A.stream_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert [r.events for r in spark.table("sess").collect()] == [26]
