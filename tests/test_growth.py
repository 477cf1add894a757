"""Compact tables whose long work must spread over all cores."""
from conftest import plan_of
from pyspark.sql import functions as F

from leakscope.operators.detect import scan
from leakscope.plans.catalogue import QUERIES
from leakscope.sources.corpus import corpus_documents


def test_texts_of_a_compact_table_are_spread_over_all_cores(spark):
    key = F.when(F.col("id") % 10 < 8, F.lit(7)).when(F.col("id") % 10 == 8, F.col("id"))  # mostly one key, some null
    customers = spark.range(0, 4000, 1, 1).select(key.alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit("x" * 50).alias("c_name"))
    parts = corpus_documents(customers).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("t")).collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and sum(r.n for r in parts) == 4000
    assert max(r.n for r in parts) < 2 * 4000 / len(parts)


def test_profiles_are_spread_before_their_entries_are_scanned(spark, sf):
    from leakscope.plans import scans as P

    seen, real = [], P.scan_profiles
    P.scan_profiles = lambda profiles, *rest: seen.append(profiles) or real(profiles, *rest)
    try:
        QUERIES["scan_profiles"](spark, sf)
    finally:
        P.scan_profiles = real
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_findings_of_two_filter_passes_are_scanned_once(spark, sf):
    assert "customer.parquet" not in plan_of(QUERIES["fake_filter_scored"](spark, sf))


def test_no_text_is_made_by_the_tasks_that_read_a_compact_table(spark):
    customers = spark.range(0, 1000, 1, 1).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"))
    plan = plan_of(scan(corpus_documents(customers)).filter(F.col("path") != "src/f1.py"))
    above, below = plan.split("RoundRobinPartitioning")
    assert "Filter" in above and "Filter" not in below
    assert scan(corpus_documents(customers.union(customers))).count() == 2 * scan(corpus_documents(customers)).count() > 0


def test_the_only_match_of_an_ascii_text_is_located_without_a_split(spark):
    import re

    from leakscope.functions.spans import between_spans, match_spans, resolve_overlaps

    texts = ["a 12 b", "12", "", None, "12 34", "é 12 x", "\U0001f600 12", "\U0001f600 1\U0001f600 23 456. One. Two\n", " . ", "x. 7 y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = df.select("id", "t", match_spans(F.col("t"), r"\d+").alias("m"), between_spans(F.col("t"), r"\.\s+").alias("b"))
    for r in out.collect():
        if r.t is None:
            continue
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", r.t)]
        cuts = [(0, 0), *(m.span() for m in re.finditer(r"\.\s+", r.t)), (len(r.t), 0)]
        assert [tuple(x) for x in r.b] == [(a, z, r.t[a:z]) for (_, a), (z, _) in zip(cuts, cuts[1:]) if z > a]
    plan = plan_of(out)
    assert "regexp_instr" in plan and "(size(" in plan

    kind = "struct<start:int,end:int,ordinal:int,confidence:decimal(6,3)>"
    cases = [([(5, 9, 1, 1), (0, 5, 0, 1)], [0, 5]), ([(3, 9, 1, 2), (0, 5, 0, 1), (9, 12, 2, 1)], [3, 9]), ([(0, 2, 0, 1), (4, 6, 1, 1), (5, 8, 2, 3)], [0, 5])]
    for spans, starts in cases:
        rows = spark.range(1).select(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("start", "end", "ordinal", "confidence"))]) for s in spans]).cast(f"array<{kind}>").alias("s"))
        kept = rows.select(resolve_overlaps(F.col("s"), kind).alias("k"))
        assert [x.start for x in kept.first().k] == starts
        assert "forall" in kept._jdf.queryExecution().analyzed().toString()


def test_a_text_that_is_one_sentence_is_judged_once(spark):
    from leakscope.operators.detect import with_context_features

    texts = ["my ssn 123-45-6789 was leaked", "My test. The ssn 123-45-6789 it was", "a demo\nssn 123-45-6789", "ssn\n123-45-6789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    plan = with_context_features(df, "text")._jdf.queryExecution().analyzed().toString()
    assert "_sentences#" in next(line for line in plan.splitlines() if "AS _whole" in line)
    found = {r.doc_id: [(f.type, f.keyword, f.owned, f.has_sentence) for f in r._features] for r in with_context_features(df, "text").collect()}
    assert found == {0: [("SSN", True, True, True)], 1: [("SSN", True, False, True)], 2: [], 3: [("SSN", False, False, True)]}
