"""Landed bodies with error rows, sessions with late rows, numbers over a frame that is made once."""
import json
import re
from datetime import datetime, timedelta

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from check import compare, connect
from leakscope.operators.numbering import number_rows
from leakscope.plans.catalogue import QUERIES, SQL
from leakscope.sources.landed import FORUM, PASTES, landed_items
from leakscope.streaming import memory
from leakscope.streaming.sessions import sessions_with_late


@pytest.mark.parametrize("name", ["landed_errors", "stream_sessions_late", "numbered_findings"])
def test_query(spark, sf, name):
    status, n, _a, _b, note = compare(spark, connect(sf), sf, name, QUERIES[name], SQL[name])
    assert status == "ok" and n > 0, note


def test_every_query_shows_both_parts(spark, sf):
    rows = QUERIES["landed_errors"](spark, sf).groupBy("part", F.regexp_replace("what", "[0-9]+", "").alias("w")).count().collect()
    assert {r.w for r in rows if r.part == "error"} == {f"Scan failed: {m}" for m in (
        "no content", "unreadable record", "no list at $", "no key", "key is no string", "size is no int")}
    assert {r.part for r in rows} == {"item", "error"}


# ---------------------------------------------------------------- landed bodies

def test_bodies_of_any_shape(spark):
    bodies = ['[{"key":"a","size":3},{"key":"b","size":"7"},{"key":"c","size":"many"},{"title":"x"},null,5]', None, "  \n", '[{"key":"a"', "not json {", '{"a":1}', "[]",
              '[{"key":{"a":1}},{"key":["a"]},{"key":null},{"key":"z","title":null,"more":1}]', "null", '[[]]', "x" * 300_000, '[{"key":"a","size":99999999999}]']
    df = spark.createDataFrame([(i, "t", 9, b) for i, b in enumerate(bodies)], "id int, target string, `no key` int, body string")
    out = landed_items(df, PASTES)
    items = {(r.id, r.position): (r.key, r.title, r.size) for r in out.items.collect()}
    assert items == {(0, 0): ("a", None, 3), (0, 1): ("b", None, 7), (7, 3): ("z", None, None)}
    errors = {(r.id, r.position): r.message.removeprefix("Scan failed: ") for r in out.errors.collect()}
    assert errors == {(0, 2): "size is no int", (0, 3): "no key", (0, 4): "no key", (0, 5): "no key", (1, None): "no content", (2, None): "no content", (3, None): "unreadable record",
                      (4, None): "unreadable record", (5, None): "no list at $", (7, 0): "key is no string", (7, 1): "key is no string", (7, 2): "no key", (8, None): "no list at $",
                      (9, 0): "no key", (10, None): "unreadable record", (11, 0): "size is no int"}
    assert out.errors.columns == ["id", "target", "no key", "position", "message"]
    assert not re.search("Exchange|Python", plan_of(out.items) + plan_of(out.errors))
    assert landed_items(df.limit(0), PASTES).items.count() == 0


def test_items_below_the_root(spark):
    good = {"data": {"children": [{"data": {"id": "t1", "selftext": "s"}}, {"kind": "more"}]}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, '{"data":{"children":{"0":1}}}'), (3, "{}")], "id int, body string")
    out = landed_items(df, FORUM)
    assert [(r.id, r.position, r.selftext) for r in out.items.collect()] == [(1, 0, "s")]
    assert sorted((r.id, r.position, r.message) for r in out.errors.collect()) == [
        (1, 1, "Scan failed: no id"), (2, None, "Scan failed: no list at $.data.children"), (3, None, "Scan failed: no list at $.data.children")]


# ---------------------------------------------------------------- sessions

START = datetime(2024, 1, 1)


def run_sessions(spark, folder, runs, partitions=1):
    session = memory.state_session(spark)
    schema = "who string, ts timestamp, other int"
    for rows in runs:
        frame = spark.createDataFrame([(w, None if s is None else START + timedelta(seconds=s), 0) for w, s in rows], schema)
        frame.repartition(partitions).write.mode("append").parquet(f"{folder}/landing")
        found = sessions_with_late(session.readStream.schema(schema).parquet(f"{folder}/landing"), ["who"], "ts", 600, "1 hour")
        found.writeStream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    seconds = lambda t: int((t - START).total_seconds())
    return sorted((r.part, r.who or "", seconds(r.session_start), seconds(r.last_event), r.events) for r in rows)


def test_rows_join_sessions_of_earlier_runs_until_the_watermark(spark, tmp_path):
    runs = [
        [("a", 0), ("a", 500), ("a", 1700), (None, 100), ("a", None), ("b", 5000)],  # the watermark comes to 1400
        [("a", 1100), ("a", 1100), ("b", 5600), ("a", 30), ("a", 40), ("b", 9000)],  # 1100 lies in an ended slot, as 30 and 40 do; the watermark comes to 5400
        [("b", 4801), ("b", 50_000)],  # in a slot that has ended: 4800 to 5399
        [("b", 50_100)],
    ]
    out = run_sessions(spark, str(tmp_path), runs, 2)
    assert [r for r in out if r[0] == "late"] == [("late", "a", 30, 40, 2), ("late", "a", 1100, 1100, 2), ("late", "b", 4801, 4801, 1)]
    assert [r for r in out if r[0] == "session"] == [("session", "", 100, 100, 1), ("session", "a", 0, 500, 2), ("session", "a", 1700, 1700, 1), ("session", "b", 5000, 5600, 2), ("session", "b", 9000, 9000, 1)]


def test_a_session_over_many_slots_and_a_hot_key(spark, tmp_path):
    runs = [[("hot", s) for s in range(lo, lo + 20_000, 7)] for lo in (0, 20_000, 40_000)] + [[("x", 100_000)], [("x", 100_001)]]
    out = run_sessions(spark, str(tmp_path), runs, 4)
    n = sum(len(r) for r in runs[:3])
    assert out == [("session", "hot", 0, 40_000 + (20_000 - 1) // 7 * 7, n)]


# ---------------------------------------------------------------- numbers

def test_the_frame_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    rows = number_rows(spark.range(2000).select((F.col("id") % 3).alias("g"), seen("id").alias("v")), "g", ["v"]).collect()
    assert made.value == 2000
    assert all(r.row_no == r.v // 3 + 1 for r in rows)
