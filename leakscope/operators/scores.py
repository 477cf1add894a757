"""Scores of texts: each distinct text is classified once, in a run or over all runs, and joined back with its frequent texts apart."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.text import is_blank
from leakscope.operators.numbering import checkpointed
from leakscope.sources.versions import VersionedTable

SCORES = "key string, scores map<string,double>"
#: Texts of more rows than this, and more than one in SHARE of all rows, are joined by a broadcast; there are at most SHARE of them.
FREQUENT, SHARE = 10_000, 1_000


class KeptScores:
    """A stored table of scores by the hash of their text, which runs add to. One table belongs to one classifier."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = VersionedTable(spark, path, SCORES, "key", buckets)

    def read(self) -> DataFrame:
        """One row per text, also where two runs at the same time have classified one."""
        return self.table.read().dropDuplicates(["key"])

    def add(self, scores: DataFrame, run: str) -> None:
        self.table.append(scores, run)


def classified(texts: DataFrame, column: str, scorer: Callable, kept: KeptScores | None = None) -> DataFrame:
    """(key, scores) of every distinct text that isn't blank; the key is its MD5.

    `scorer` takes and yields pandas frames: in `column`, out `column` and `scores` (label -> probability). With `kept`, only texts that it
    lacks are classified; their scores are added to it under a run of their own, written before anything is joined to them.
    """
    distinct = texts.select(column).filter(~is_blank(F.col(column))).distinct()
    ask = lambda rows: rows.mapInPandas(scorer, f"{column} string, scores map<string,double>").select(F.md5(column).alias("key"), "scores")
    if kept is None:
        return ask(distinct)
    known = kept.table.read().select("key")
    new = checkpointed(ask(distinct.join(known, F.md5(column) == known["key"], "left_anti")))
    if not new.isEmpty():
        # named by what it adds to, so a run that another one has overtaken is told so
        kept.add(new, f"after-{kept.table.manifest()['version']}")
    return kept.read()


def with_scores(rows: DataFrame, scores: DataFrame, key: str, frequent: int = FREQUENT) -> DataFrame:
    """Rows with the `_scores` of their key, which goes; null without any.

    Null keys join nothing, so they don't travel. Keys of a large share of the rows are few, so their scores are broadcast and their
    rows stay where they are; the other keys are joined by a shuffle.
    """
    table = scores.select(F.col("key").alias("_sk"), F.col("scores").alias("_scores"))
    keyed = rows.filter(F.col(key).isNotNull())
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("_n") > max(frequent, total // SHARE)).select(F.col(key).alias("_hot"))
    known = F.broadcast(table.join(F.broadcast(hot), F.col("_sk") == F.col("_hot"), "right").select("_hot", "_scores"))  # at most SHARE rows
    few = F.broadcast(hot)
    apart = keyed.join(known, keyed[key] == F.col("_hot")).drop("_hot")
    rest = keyed.join(few, keyed[key] == F.col("_hot"), "left_anti").join(table, F.col(key) == F.col("_sk"), "left").drop("_sk")
    none = rows.filter(F.col(key).isNull()).withColumn("_scores", F.lit(None).cast(table.schema["_scores"].dataType))
    return apart.unionByName(rest).unionByName(none).drop(key)
