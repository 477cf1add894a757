"""Named queries over the test tables, each with its SQL twin where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators.detect import scan
from leakscope.plans.oracle_sql import IDENTITY_SQL
from leakscope.sources.corpus import corpus_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_documents(table(spark, sf, "customer"))


def identity(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return spark.sql(IDENTITY_SQL.replace("from part)", "from {part})"), part=part)


def corpus_findings(spark: SparkSession, sf: str, profile: str = "fast", masked: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    return scan(corpus(spark, sf), profile, masked=masked, fields=fields)


def joined(col: str | Column) -> Column:
    return F.array_join(F.col(col) if isinstance(col, str) else col, ",")


def dbl(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")
