"""Raw documents to a training mix in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame, which is written as
Parquet before the next begins. All but the last return the columns of `documents`; the last adds `copy`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakscope.llm.common import stored
from leakscope.llm.decontaminate import decontaminate
from leakscope.llm.mixing import mix_sources
from leakscope.llm.neardup import drop_near_duplicates
from leakscope.llm.pseudonyms import pseudonymise
from leakscope.llm.quality import keep_good
from leakscope.llm.queries import DEMO_KEY, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others. Without labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays: five words, similarity 0.8. Texts without words all stay."""
    return drop_near_duplicates(docs, window=5, percent=80)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of the same format; no row goes."""
    return pseudonymise(docs, DEMO_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says, in random order."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("pii", identifiers), ("mixing", mixed)]
#: A trained classifier and keyed pseudonyms are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
