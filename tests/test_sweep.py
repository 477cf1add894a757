"""Sentences by a sweep over offsets, first rows of hot groups by ranges."""
import random
import uuid

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from test_layout_scores import exchanged, no_broadcast  # noqa: F401

from leakscope.operators import context as X
from leakscope.operators import rollups as R
from leakscope.sources.layout import land_bucketed


def plain(spans, sentences):
    out = []
    for doc, kind, start, end in spans:
        held = [t for d, s, e, t in sentences if d == doc and s <= start and end <= e]
        out.append((doc, kind, start, end, held[0] if held else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_sweep_like_plain_version(spark, parts):
    random.seed(parts)
    spans, sentences = [], []
    for doc in [*range(20), None]:
        at = 0
        for _ in range(random.choice([0, 1, 4, 300 if doc == 3 else 9])):
            at += random.choice([0, 1, 5])
            length = random.randint(1, 12)
            if random.random() < 0.8:
                sentences.append((doc, at, at + length, f"{doc}:{at}"))
            at += length
        for _ in range(random.choice([0, 3, 600 if doc == 3 else 12])):  # one document holds most spans
            start = random.randint(0, max(at, 1))
            spans.append((doc, "T", start, start + random.randint(0, 6)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(spans, "doc_id long, type string, start int, end int").repartition(3)
        sent = spark.createDataFrame(sentences, "doc_id long, s int, e int, text string")
        got = X.sentence_of_span(df, sent)
        assert got.columns == ["doc_id", "type", "start", "end", "sentence"]
        want = [(d, k, s, e, t if d is not None else "") for d, k, s, e, t in plain(spans, sentences)]  # a null id names no document
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert X.sentence_of_span(df.limit(0), sent).count() == 0
        assert {r.sentence for r in X.sentence_of_span(df, sent.limit(0)).collect()} == {""}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_sentence_text_moves(spark, tmp_path, no_broadcast):  # noqa: F811
    docs = spark.createDataFrame([(1, "First one. my pan ABCPE1234F here. Last.")] * 1, "doc_id long, text string")
    sentences = land_bucketed(X.split_sentences(docs), f"sent_{uuid.uuid4().hex}", str(tmp_path / "s"), ("doc_id", "s"), 4)
    spans = spark.createDataFrame([(1, 18, 28)], "doc_id long, start int, end int")
    out = X.sentence_of_span(spans, sentences)
    below = exchanged(plan_of(out))
    assert below and not any("text#" in line or "sentence#" in line for line in below)
    assert out.first().sentence == "my pan ABCPE1234F here."


def test_first_rows_of_a_hot_group_lie_in_even_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("g"), F.xxhash64("id").alias("o"))
    for n in (1, 777, 36_000, 50_000):
        got = R.first_by_range(rows, "g", ["o"], n)
        kept = {r.g: (r.n, r.m) for r in got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("o").alias("m")).collect()}
        each = {}
        for g, o in sorted((r.g, r.o) for r in rows.collect()):
            each.setdefault(g, []).append(o)
        assert kept == {g: (min(n, len(v)), v[min(n, len(v)) - 1]) for g, v in each.items()}
    spread = R.first_by_range(rows, "g", ["o"], 50_000).groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in spread.collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and sum(sizes) == 40_000
