import random

import brute
import pytest
from pyspark.sql import functions as F

from leakscope.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def run(df, **how):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, **how).collect())


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_like_brute_force_over_several_cells(spark, parts):
    random.seed(parts)
    rows = [(i, [random.uniform(-1, 1) for _ in range(7)]) for i in range(0, 260)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(i, e, "x", 0) for i, e in rows], SCHEMA)
    got = run(df, k=5, parts=parts, query_block=6, shard=50)
    exact = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert got == brute.top_k(exact, 5)


def test_unusable_vectors_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0]), (2, [0.5, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [])]
    got = run(spark.createDataFrame([(i, e, None, None) for i, e in rows], SCHEMA), k=20)
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 2048), (0, 3, 7, 0)]


def test_empty_table_and_lone_query(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(20, [1.0], "", 1)], SCHEMA)) == []


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [1e6, -3e6]), (1, [2e6, 1e6]), (2, [1e6, -3e6])], "vec_id long, embedding array<double>")
    a, b = [64_000_000, -192_000_000], [128_000_000, 64_000_000]
    assert run(df, k=2) == [(0, 1, 2, a[0] ** 2 + a[1] ** 2), (0, 2, 1, a[0] * b[0] + a[1] * b[1])]
