"""What the physical plans must and must not hold."""
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from leakscope.operators import ess as E
from leakscope.operators import rollups as R
from leakscope.operators.detect import lexical_scorer, scan
from leakscope.plans.registry import table
from leakscope.streaming.alerts import alert_sessions


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan_of(df)))


def test_scan_is_one_stage_without_python(spark, sf):
    for profile in ("fast", "context", "extended", "strict"):
        df = scan(table(spark, sf, "documents"), profile, filename=None)
        plan = plan_of(df)
        assert exchanges(df) == 0 and "Python" not in plan and "Pandas" not in plan
        # the detection expression appears once: one explode for chunks, one for findings
        assert len(re.findall(r"Generate explode", plan)) == 2


def test_scan_reads_only_what_it_needs(spark, sf):
    df = scan(table(spark, sf, "documents").select("doc_id", "text"), filename=None).select("doc_id", "type")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(df)
    assert "IsNotNull(text)" in plan_of(df)


def test_score_and_summary_need_two_shuffles(spark, sf):
    found = scan(table(spark, sf, "documents"), filename=None).withColumns({"source_type": F.lit("unknown"), "scan_id": F.lit(1)})
    scored = E.ess(found, ["scan_id", "source"], "source_type")
    assert exchanges(scored) == 1
    assert exchanges(E.scan_summary(scored, "scan_id")) <= 2
    assert "partial_" in plan_of(scored)


def test_group_limit_cuts_before_the_shuffle(spark, sf):
    orders = table(spark, sf, "orders")
    small = plan_of(R.limit_per_group(orders, "o_custkey", ["o_orderkey"], 5))
    assert small.count("WindowGroupLimit") == 2
    large = R.limit_per_group(orders, "o_orderstatus", ["o_orderkey"], 2000)
    assert "_salt" in plan_of(large)
    assert large.count() == orders.count()


def test_top_k_is_not_a_sort(spark, sf):
    found = scan(table(spark, sf, "documents"), filename=None).withColumn("detected_at", F.lit(1))
    assert "TakeOrderedAndProject" in plan_of(R.alert_sample(found))


def test_aggregates_combine_before_the_shuffle(spark, sf):
    ev = table(spark, sf, "events")
    for df in (R.first_per_value(ev.withColumnsRenamed({"event_type": "type", "value": "v"}).withColumn("value", F.col("user_id")), ["ts", "event_id"]),
               alert_sessions(ev, ["user_id"], "ts", 1800)):
        assert "partial_min" in plan_of(df)


def test_no_cross_join_and_no_local_checkpoint_in_the_catalogue(spark, sf):
    from leakscope.plans.catalogue import QUERIES

    for name in ("ess_by_file", "identity_links", "sentence_of_span", "entities_near", "first_nonempty", "combined_scan", "type_distribution"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_unwanted_fields_are_not_computed(spark):
    docs = spark.createDataFrame([(1, "Mail me: jane.roe@corp-mail.com or 4111 1111 1111 1111"), (2, "nothing"), (3, None)], "doc_id int, text string")
    every, some = scan(docs, filename=None), scan(docs, filename=None, fields=("type", "value"))
    assert some.columns == ["doc_id", "type", "value"] and every.count() == 2
    assert sorted(some.collect()) == sorted(every.select("doc_id", "type", "value").collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "AS snippet" in plan(every) and "AS snippet" not in plan(some) and "value_masked" not in plan(some)
    cut = scan(docs, filename=None, chunk_size=20, overlap=30, fields=("type",))
    assert cut.columns == ["doc_id", "type"] and cut.count() == 2
    with pytest.raises(ValueError):
        scan(docs, filename=None, fields=("severity",))


def test_kept_expressions_serve_any_number_of_scans(spark):
    docs = spark.createDataFrame([(1, "This was leaked. Write to jane.roe@corp-mail.com now. My number is 9876543210.")], "doc_id int, text string")
    first, again = (sorted(scan(docs, "context", filename=None).collect()) for _ in range(2))
    own = sorted(scan(docs, "context", scorer=lambda s: lexical_scorer(s), filename=None).collect())
    other = sorted(scan(docs.withColumnRenamed("text", "body"), "context", text="body", filename=None).collect())
    assert first and first == again == own == other
