"""Exact top-k search by inner product with a three-phase uniform threshold.

The components are dealt to a few parts, and every part of every shard of vectors is a node that knows only its share of a
score. Phase 1 gathers each node's own best lists and gets from them a cutoff that the k-th best score can't be below. Phase 2
sends the cutoff back to the nodes: a vector whose score reaches it has a share of at least cutoff / parts in some part, so
the nodes report those alone. Phase 3 adds the shares that are missing and ranks.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import stored

PARTS = 2
#: A cell of the grid compares so many queries with so many vectors.
QUERY_BLOCK, SHARD = 1024, 4096
CELL = "qb int, sh int, q long, obj long"


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for to, x in zip(out, rows, strict=True):
        to[: len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; doubles are exact up to 2^53."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else a @ b.T


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    width = max(1, int(pdf["x"].map(len).max()))
    return pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1], width


def _local_lists(length: int):
    """Phase 1 in a node: the `length` best vectors of every query by this part's share."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, objects, width = _sides(pdf)
        if queries.empty or objects.empty:
            return pd.DataFrame({"qb": [], "sh": [], "q": [], "obj": []})
        share = _products(_matrix(queries["x"], width), _matrix(objects["x"], width))
        n = min(length, share.shape[1])
        best = np.argpartition(-share, n - 1, axis=1)[:, :n]
        return pd.DataFrame({"qb": pdf["qb"].iat[0], "sh": pdf["sh"].iat[0], "q": np.repeat(queries["id"].to_numpy(), n), "obj": objects["id"].to_numpy()[best.ravel()]})

    return run


def _over_threshold(parts: int):
    """Phase 2 in a node: the vectors whose share reaches the uniform threshold cutoff / parts; all where there is no cutoff."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, objects, width = _sides(pdf)
        if queries.empty or objects.empty:
            return pd.DataFrame({"qb": [], "sh": [], "q": [], "obj": [], "share": []})
        share = _products(_matrix(queries["x"], width), _matrix(objects["x"], width))
        least = queries["least"].to_numpy()
        i, j = np.nonzero(share >= -((-least) // parts)[:, None])
        return pd.DataFrame({"qb": pdf["qb"].iat[0], "sh": pdf["sh"].iat[0], "q": queries["id"].to_numpy()[i], "obj": objects["id"].to_numpy()[j], "share": share[i, j]})

    return run


def _resolved(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact scores of the pairs of a cell."""
    pairs = pdf[pdf["kind"] == 2]
    if pairs.empty:
        return pd.DataFrame({"q": [], "obj": [], "score": []})
    queries, objects, width = _sides(pdf[pdf["kind"] < 2])
    a, b = _matrix(queries["x"], width), _matrix(objects["x"], width)
    at_q, at_o = pd.Index(queries["id"]).get_indexer(pairs["id"]), pd.Index(objects["id"]).get_indexer(pairs["obj"])
    score = np.concatenate([(a[at_q[k : k + 65536]] * b[at_o[k : k + 65536]]).sum(axis=1) for k in range(0, len(pairs), 65536)])
    return pd.DataFrame({"q": pairs["id"].to_numpy(), "obj": pairs["obj"].to_numpy(), "score": score})


def _best(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def quantised(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, parts: int = PARTS, query_block: int = QUERY_BLOCK,
          shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row that is a query, the k other rows with the highest integer inner
    product of floor(scale * x), ties to the smaller vec_id; all rows if there are fewer.

    Rows without vec_id, and vectors that are null or hold a null or non-finite component, take no part. Of rows that share a
    vec_id, the one with the smallest vector counts. Shorter vectors are filled with zeros. Equal vectors are one object with
    its k + 1 smallest ids (no result needs more of them), so ties of thousands of copies cost what one vector does.
    """
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    clean = vectors.filter(F.col("vec_id").isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), quantised(F.col("embedding"), scale).alias("v"))
    clean = clean.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    few = _best(clean, "v", [F.col("vec_id")], k + 1)
    objects = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("obj"), "v", "ids"), "objects")
    asked = stored(clean.filter("is_query").join(objects.select("v", "obj"), "v").select("vec_id", "obj"), "asked")

    size = objects.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards, width = max(1, math.ceil(size[0] / shard)), max(1, math.ceil(size[1] / parts))
    query_blocks = max(1, math.ceil(asked.select("obj").distinct().count() / query_block))
    placed = objects.select("obj", "v", F.pmod(F.xxhash64("obj"), F.lit(shards)).cast("int").alias("sh"))
    queries = stored(objects.join(asked.select("obj").distinct(), "obj").select("obj", "v", F.pmod(F.xxhash64("obj", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb")), "queries")

    def cells(queries: DataFrame, sliced: bool) -> DataFrame:
        """Every block of queries beside every shard of vectors, by part or whole."""
        cut = F.expr(f"transform(sequence(0, {parts - 1}), j -> struct(j as part, slice(v, j * {width} + 1, {width}) as x))") if sliced else F.array(F.struct(F.lit(0).alias("part"), F.col("v").alias("x")))
        rows = queries.select("qb", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("sh"), F.lit(0).alias("kind"), F.col("obj").alias("id"), "least", "v").unionAll(
            placed.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "sh", F.lit(1).alias("kind"), F.col("obj").alias("id"), F.lit(None).cast("long").alias("least"), "v"))
        return rows.select("qb", "sh", "kind", "id", "least", F.explode(cut).alias("c")).select("qb", "sh", "c.part", "kind", "id", "least", "c.x")

    def resolve(pairs: DataFrame) -> DataFrame:
        whole = cells(queries.withColumn("least", F.lit(None).cast("long")), False).select("qb", "sh", "kind", "id", F.lit(None).cast("long").alias("obj"), "x")
        extra = pairs.select("qb", "sh", F.lit(2).alias("kind"), F.col("q").alias("id"), "obj", F.array().cast("array<long>").alias("x"))
        return whole.unionAll(extra).groupBy("qb", "sh").applyInPandas(_resolved, "q long, obj long, score long")

    # 1: local lists, their exact scores, and from them the cutoff
    first = cells(queries.withColumn("least", F.lit(None).cast("long")), True).groupBy("qb", "sh", "part").applyInPandas(_local_lists(k + 1), CELL).distinct()
    seen = _best(resolve(first), "q", [F.desc("score")], k + 1)
    cutoff = stored(seen.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("cutoff")).withColumnRenamed("q", "obj"), "cutoffs")
    # 2: the cutoff goes to all nodes
    told = queries.join(cutoff, "obj", "left").withColumn("least", F.coalesce("cutoff", F.lit(-(2**62))))
    over = cells(told, True).groupBy("qb", "sh", "part").applyInPandas(_over_threshold(parts), CELL + ", share long")
    shares = stored(over.groupBy("qb", "sh", "q", "obj").agg(F.sum("share").alias("score"), F.count(F.lit(1)).alias("n")), "shares")
    # 3: shares below the threshold are added
    exact = shares.filter(F.col("n") == parts).select("q", "obj", "score").unionAll(resolve(shares.filter(F.col("n") < parts)))
    enough = exact.join(cutoff.withColumnRenamed("obj", "q"), "q", "left").filter(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff")))
    named = enough.join(objects.select("obj", "ids"), "obj").select("q", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.col("vec_id")]
    short = _best(named, "q", order, k + 1).select(F.col("q").alias("obj"), "score", "vec_id")
    found = asked.withColumnRenamed("vec_id", "query_id").join(short, "obj").filter("vec_id != query_id")
    return _best(found, "query_id", order, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
