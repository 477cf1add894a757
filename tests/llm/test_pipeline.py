import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from check import compare, connect
from leakscope.llm.common import stored
from leakscope.llm.queries import DEMO_KEY, QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_its_sql(spark, sf, name):
    status, _n, _a, _b, note = compare(spark, connect(sf), sf, name, QUERIES[name], SQL[name])
    assert status == "ok", note


def test_a_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_stages_like_plain_versions(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs = documents.withColumns({"k_id": F.lit("x"), "score": F.lit(1), "p": F.lit(None).cast("string")})  # names that stages use
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf), name))
    assert all(d.columns == columns for d in seen[:-1]) and seen[-1].columns == [*columns, "copy"]
    ids = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    wrong = [i for i in ids[0] if i in labels and (i in ids[1]) != (labels[i] == 1)]
    assert len(wrong) <= 3  # fitted on some 50 rows here
    groups = brute.near_duplicates(list(ids[1].items()), 5, 80)
    assert set(ids[2]) == {i for i, (_, root) in groups.items() if i == root}
    hit = {r.doc_id for r in QUERIES["op7_benchmark_decontamination"](spark, sf).filter("contaminated").collect()}
    assert set(ids[3]) == set(ids[2]) - hit and hit & set(ids[2])
    pseudonyms = {r.doc_id: r.text for r in QUERIES["op6_feistel_pseudonyms"](spark, sf).collect()}
    assert DEMO_KEY and ids[4] == {i: pseudonyms[i] for i in ids[3]}
    sources = {r.source: r["count"] for r in seen[4].groupBy("source").count().collect()}
    total = sum(n**0.5 for n in sources.values())
    rates = {s: n**0.5 / total * len(ids[4]) / n for s, n in sources.items()}
    of = {r.doc_id: r.source for r in seen[4].collect()}
    assert {r.doc_id: r["count"] for r in seen[5].groupBy("doc_id").count().collect()} == {i: c for i in ids[4] if (c := brute.copies(i, rates[of[i]], 42))}


def test_stages_on_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 50_000, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), name)
        assert docs.count() <= 20
