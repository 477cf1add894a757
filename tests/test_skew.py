"""Inputs where one key holds a third of the rows or more."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from leakscope.operators.links import identity_links
from leakscope.operators.numbering import number_rows
from leakscope.operators.rollups import first_per_value, limit_per_group
from leakscope.streaming.alerts import alert_sessions


def skewed(spark, n=6000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
        F.pmod(F.col("id") * 7919, F.lit(100003)).alias("pos"), "id")


def test_number_rows(spark):
    df = skewed(spark)
    got = number_rows(df, "key", ["pos", "id"])
    want = df.withColumn("row_no", F.row_number().over(Window.partitionBy("key").orderBy("pos", "id")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_limit_per_group(spark):
    df = skewed(spark)
    for n in (3, 1500):
        got = limit_per_group(df, "key", ["pos", "id"], n)
        want = df.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("pos", "id"))).filter(F.col("_r") <= n).drop("_r")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_per_value(spark):
    df = skewed(spark).withColumnsRenamed({"key": "type"}).withColumn("value", F.lit("v"))
    got = {(r.type, r.id) for r in first_per_value(df, ["pos", "id"]).collect()}
    rows = df.collect()
    want = {}
    for r in rows:
        best = want.get(r.type)
        want[r.type] = r if best is None or (r.pos, r.id) < (best.pos, best.id) else best
    assert got == {(t, r.id) for t, r in want.items()}


def test_sessions_equal_session_windows(spark):
    ev = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("user"),
        F.timestamp_seconds(F.pmod(F.col("id") * 104729, F.lit(900000))).alias("ts"))
    got = alert_sessions(ev, ["user"], "ts", 600).select("user", "session_start", F.col("events"))
    want = ev.groupBy("user", F.session_window("ts", "600 seconds").alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user", "w.start", "events")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_at_exact_gap(spark):
    ev = spark.createDataFrame([(1, 0), (1, 600), (1, 1199), (1, 1800)], "user int, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    got = alert_sessions(ev, ["user"], "ts", 600).count()
    want = ev.groupBy("user", F.session_window("ts", "600 seconds")).count().count()
    assert got == want == 2  # 1199 to 1800 is one second too long


def test_links(spark):
    rows = [("EMAIL", "A@x.io", "p1")] * 500 + [("EMAIL", "a@x.io", "p2"), ("PHONE", "+91 9876543210", "p1"), ("PHONE", "9876543210", "p3"), ("PAN", "ABCPE1234F", "p1")]
    out = {r.type: r for r in identity_links(spark.createDataFrame(rows, "type string, value string, platform string")).collect()}
    assert set(out) == {"EMAIL_ADDRESS", "PHONE_NUMBER_INDIA"}
    assert (out["EMAIL_ADDRESS"].platforms, out["EMAIL_ADDRESS"].findings) == (2, 501)
