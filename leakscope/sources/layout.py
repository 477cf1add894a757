"""Tables laid out by hash buckets, so that two of them meet without an exchange."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A listing and its contents are dealt out alike.
FILE_KEY = ("repo", "branch", "path")
BUCKETS = 256


def land_bucketed(rows: DataFrame, name: str, path: str, key: Sequence[str] = FILE_KEY, buckets: int = BUCKETS) -> DataFrame:
    """Write rows to a folder of Parquet files in hash buckets by a key, sorted in each, and name it in the catalog.

    One exchange when the table is landed; joins by the key with a table of as many buckets then need none. One file per bucket, so a
    bucket is a task later: choose `buckets` by the size of the table.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, *key)
    dealt.write.format("parquet").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return spark.table(name)


def bucketed_table(spark: SparkSession, name: str, path: str, schema: str, key: Sequence[str] = FILE_KEY, buckets: int = BUCKETS) -> DataFrame:
    """A folder that `land_bucketed` wrote in another session, under a name in this session's catalog."""
    by = ", ".join(f"`{k}`" for k in key)
    spark.sql(f"create table if not exists `{name}` ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {int(buckets)} buckets location '{path}'")
    return spark.table(name)


def spread(rows: DataFrame, per_core: int = 2) -> DataFrame:
    """The rows in even parts, several for each core. For compact tables from which long work is made: a file of a few MB, or one of few
    row groups, is read by few tasks, however many rows it holds. No key decides, so keys that repeat or are null do no harm.

    The condition holds for every row. As it depends on the task, Spark moves no later filter below the exchange, where the few tasks
    that read the file would make the texts for it.
    """
    parts = rows.repartition(per_core * rows.sparkSession.sparkContext.defaultParallelism)
    return parts.filter(F.spark_partition_id() >= 0)
