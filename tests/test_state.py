"""State between runs, stored history with versions, batches that count whole."""
import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from test_streaming import doc, land

from leakscope.plans import state_queries as SQ
from leakscope.sources.sinks import leak_records
from leakscope.sources.versions import Conflict, Folder, VersionedTable
from leakscope.streaming import alerts as A
from leakscope.streaming import memory as M

SCHEMA = "user_email string, id long, note string"


# --- new since the last scan -------------------------------------------------------------------------------------

def findings(spark, rows):
    return spark.createDataFrame(rows, "type string, value string, at string").select(
        "type", "value", F.to_timestamp("at").alias("detected_at"))


def run_once(spark, tmp_path, again="10 hours", stored=None, horizon="1 hour"):
    session = M.state_session(spark)
    stream = session.readStream.schema("type string, value string, detected_at timestamp").parquet(str(tmp_path / "in"))
    new = M.new_since_last(stream, again, None if stored is None else session.read.parquet(stored), horizon)
    q = new.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True).start()
    q.awaitTermination()
    return sorted((r.type, r.value, str(r.detected_at)) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_alerts_once_and_again_after_its_time(spark, tmp_path):
    day = "2024-01-01 "
    put = lambda rows: findings(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
    leak_records(findings(spark, [("PAN", "ABCPE1234F", day + "00:00:00")])).select(M.KEY, "detected_at").write.parquet(str(tmp_path / "stored"))
    put([("PAN", "ABCPE1234F", day + "05:00:00"), ("SSN", "123-45-6789", day + "05:00:00"), ("SSN", "123-45-6789", day + "05:00:00.500"),
         ("SSN", "123-45-6789", day + "04:00:00"), ("SSN", None, None)])
    first = run_once(spark, tmp_path, stored=str(tmp_path / "stored"))
    assert first == [("SSN", "123-45-6789", day + "04:00:00")]
    put([("SSN", "123-45-6789", day + "13:59:59"), ("PAN", "abcpe-1234f", day + "10:00:00")])
    second = run_once(spark, tmp_path, stored=str(tmp_path / "stored"))
    assert second == sorted([*first, ("PAN", "abcpe-1234f", day + "10:00:00")])  # the stored one's time has passed, the first run's hasn't
    put([("SSN", "123-45-6789", day + "14:00:00"), ("SSN", "123-45-6789", day + "23:59:59"), ("SSN", "123-45-6789", "2024-01-02 00:00:00"),
         ("SSN", "123-45-6789", day + "01:00:00")])  # the last one is behind the watermark
    third = run_once(spark, tmp_path, stored=str(tmp_path / "stored"))
    assert third == sorted([*second, ("SSN", "123-45-6789", day + "14:00:00"), ("SSN", "123-45-6789", "2024-01-02 00:00:00")])
    assert run_once(spark, tmp_path) == third


def test_state_goes_when_its_time_has_passed(spark, tmp_path):
    put = lambda rows: findings(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
    for day in ("01", "05", "09"):
        put([("SSN", f"{day}3-45-6789", f"2024-01-{day} 00:00:00")])
        run_once(spark, tmp_path)
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck"))
    assert state.count() <= 2  # the first day's identifier is forgotten


def test_a_frequent_value_is_few_rows_in_front_of_the_shuffle(spark):
    hot = spark.range(0, 50_000, 1, 2).select(F.lit("EMAIL").alias("type"), F.lit("a@b.org").alias("value"), F.timestamp_seconds(F.col("id") / 25_000).alias("detected_at"))
    thin = M.first_of_each(hot, 1000)
    assert thin.count() <= 2 * 2 * 3  # two seconds in each batch of 10,000 rows
    assert thin.agg(F.min("_ms")).first()[0] == 0 and "Exchange" not in plan_of(thin)


def test_alert_stream_with_memory(spark, tmp_path):
    landing, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def once():
        session = M.state_session(spark)
        A.alert_stream(session, landing, None, out, ck, profile="fast", once=True, again_after="2 days").awaitTermination()

    land(landing, "1.json", [doc("pastebin", "p1", "pan ABCPE1234F", "2024-01-01T00:00:00Z"), doc("pastebin", "p2", "pan ABCPE1234F", "2024-01-01T01:00:00Z")])
    once()
    land(landing, "2.json", [doc("pastebin", "p3", "pan ABCPE1234F", "2024-01-02T00:00:00Z"), doc("pastebin", "p3", "pan ABCPE9999F", "2024-01-02T00:00:00Z")])
    once()
    land(landing, "3.json", [doc("pastebin", "p4", "pan ABCPE1234F", "2024-01-03T00:00:00Z")])
    once()
    got = sorted((r.source, r.value_masked) for r in A.committed(spark, out, "findings").collect())
    assert got == [("pastebin:p1", "ABCP****234F"), ("pastebin:p3", "ABCP****999F"), ("pastebin:p4", "ABCP****234F")]
    assert A.committed(spark, out, "alerts").agg(F.sum("total")).first()[0] == 3


# --- versions ----------------------------------------------------------------------------------------------------

def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, SCHEMA, "user_email", 8)
    assert t.read().count() == 0
    users = [f"u{i}" for i in range(40)]
    assert t.append(rows_of(spark, [(u, i, "a") for u in users for i in range(3)]), "load") == 1
    before, names = files(path), t.manifest()["buckets"]
    assert t.delete(rows_of(spark, [("u7", 1, ""), ("u7", 99, "")]), ["user_email", "id"], "delete") == 2
    changed = {b for b in names if t.manifest()["buckets"].get(b) != names[b]}
    assert len(changed) == 1 and before < files(path)
    assert all(f.split("_bucket=")[1].split("/")[0] in changed for f in files(path) - before)
    assert t.upsert(rows_of(spark, [("u7", 1, "back"), ("u7", 2, "b"), ("u7", 2, "c"), ("new", 5, "n")]), ["user_email", "id"], "upsert") == 3
    got = sorted(map(tuple, t.for_keys(["u7", "new"]).select("user_email", "id", "note").collect()))
    assert got == [("new", 5, "n"), ("u7", 0, "a"), ("u7", 1, "back"), ("u7", 2, "c")]
    assert t.read().count() == 121 and t.read(1).count() == 120 and t.read(2).count() == 119
    whole = files(path)
    assert t.append(rows_of(spark, [("x", 1, "")]), "load") == 3 and t.delete(rows_of(spark, [("u8", 1, "")]), ["user_email", "id"], "delete") == 3
    assert files(path) == whole and t.read().count() == 121


def test_a_key_goes_whole_and_null_keys_stay(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "user_email", 4)
    t.append(rows_of(spark, [("a", 1, None), (None, 2, "n"), ("b", None, "m")]), "1")
    t.delete(rows_of(spark, [("a", 1, ""), ("b", None, "")]), ["user_email"], "2")
    assert [tuple(r) for r in t.read().collect()] == [(None, 2, "n")]
    with pytest.raises(KeyError):
        t.manifest(9)


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (VersionedTable(spark, path, SCHEMA, "user_email", 4) for _ in range(2))
    stale = two.manifest()
    one.append(rows_of(spark, [("a", 1, "")]), "one")
    two.manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        two.append(rows_of(spark, [("b", 1, "")]), "two")
    del two.manifest
    assert two.append(rows_of(spark, [("b", 1, "")]), "two") == 2 and one.read().count() == 2
    assert not any(n.startswith(".") for n in Folder(spark, f"{path}/manifests").names() if not n.endswith(".crc"))


# --- batches that count whole ------------------------------------------------------------------------------------

def test_a_batch_without_commit_is_not_seen(spark, tmp_path):
    out = str(tmp_path / "out")
    found = spark.createDataFrame([("PAN", "AB****", "High", 0.65, "s", "u")], "type string, value_masked string, risk string, confidence double, source string, source_url string").withColumn(
        "detected_at", F.lit("2024-01-01").cast("timestamp"))
    sink = A.AlertSink(spark, out)
    sink(found, 0)
    SQ._StoppingSink(spark, out).write_findings(found, 1)
    with pytest.raises(SQ._Stopped):
        SQ._StoppingSink(spark, out)(found, 1)
    assert [A.committed(spark, out, w).count() for w in ("findings", "alerts")] == [1, 1]
    sink(found, 1)
    sink(found.limit(0), 1)  # committed batches stay as they are
    assert [A.committed(spark, out, w).count() for w in ("findings", "alerts")] == [2, 2]
    assert "CartesianProduct" not in plan_of(A.committed(spark, out, "findings"))


def test_the_alert_row_is_made_from_the_findings_that_were_written(spark, tmp_path):
    files, out = [], str(tmp_path / "out")

    class Seen(A.AlertSink):
        def write_alert(self, findings, batch_id):
            files.append(findings.inputFiles())
            super().write_alert(findings, batch_id)

    land(str(tmp_path / "landing"), "a.json", [doc("pastebin", "x", "call +916123456789 or +916123456780 now", "2024-01-01T00:00:00Z")])
    A.alert_stream(spark, str(tmp_path / "landing"), None, out, str(tmp_path / "state"), profile="fast", once=True, sink=Seen(spark, out)).awaitTermination()
    assert files and all(f and all("/out/findings/batch_id=" in name for name in f) for f in files)
    assert sum(r.total for r in A.committed(spark, out, "alerts").collect()) == A.committed(spark, out, "findings").count() == 2
