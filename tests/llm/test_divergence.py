"""Source divergence audit."""
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm import divergence
from leakscope.llm.divergence import share, shares, source_divergence, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, docs string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, a, s, "x", 1, "y") for i, (t, a, s) in enumerate(rows)], SCHEMA)


def results(df, **how):
    return sorted((tuple(r) for r in source_divergence(df, **how).collect()), key=repr)


@pytest.mark.parametrize("top", [200, 3])
def test_like_plain_version(spark, top):
    random.seed(top)
    vocabulary = ["the", "The", "Öl", "öl", "naïve", "x1y", "日本", "a'b", "é", "é", "😀", "z" * 80, "mid", "rare"]
    rows = []
    for _ in range(300):
        lang, source = random.choice([("en", "web"), ("en", "web"), ("en", "books"), ("en", None), ("de", "web"), ("", "news"), (None, "news"), ("fr", "é")])
        rows.append((" ".join(random.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=random.choice([0, 1, 3, 40]))), lang, source))
    rows += [(None, "en", "empty"), ("", "it", "a"), ("12 34", "it", "b"), ("once only", "pt", "a"), ("once twice", "pt", "b"), ("the the the the", "en", "web")]
    rows += rows[:20]
    got = results(docs_of(spark, rows).repartition(5), top=top)
    assert got == sorted(brute.source_divergence(rows, 3, top), key=repr)
    assert any(r[2] == "pair" and r[0] == "it" and r[4] == 0 for r in got)


def test_small_blocks_give_the_same(spark, monkeypatch):
    random.seed(2)
    rows = [(" ".join(random.choices([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], k=30)), "en", f"s{random.randrange(9)}") for _ in range(150)]
    whole = results(docs_of(spark, rows))
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "TERMS_PER_TASK", 30)
    assert results(docs_of(spark, rows).repartition(3)) == whole == sorted(brute.source_divergence(rows, 3, 200), key=repr)


def test_empty_table_and_single_source(spark):
    assert results(docs_of(spark, [])) == []
    assert [r for r in results(docs_of(spark, [("a b", "en", "x")] * 3)) if r[2] == "pair"] == []


def test_terms_of_a_long_text_are_counted_in_stretches():
    text = "Straße, naïve! " * 1000 + "x" * 500
    assert term_counts(text, piece=64) == term_counts(text) == {"straße".encode(): 1000, "naïve".encode(): 1000, b"x" * 500: 1}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (0, 7), (10**12, 10**12 + 1), (3 * 10**14, 8 * 10**15), (999_999_999, 10**9 + 7), (1, 10**15)]
    want = [1 + 10**9 * (n + 1) // total for n, total in cases]
    df = spark.createDataFrame(cases, "n long, total long")
    assert [r[0] for r in df.select(share(F.col("n"), F.col("total"))).collect()] == want
    assert [int(shares(np.array([n]), np.array([total]))[0]) for n, total in cases] == want
