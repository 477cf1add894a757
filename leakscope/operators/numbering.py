"""Dense numbering of a large ordered table without sending a group to one task."""
from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="leakscope-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder, so that later stages read the same rows in the same partitions and a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, by: str | Sequence[str], order: Sequence[Column | str], name: str = "row_no") -> DataFrame:
    """Add 1, 2, 3, ... within each group along a total order.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks. Each task numbers its own
    rows, and the counts of earlier tasks (one row per task and group) are added as offsets. The frame is written before
    its ranges are sampled, so what lies before it (a scan of texts) runs once.
    """
    keys = [by] if isinstance(by, str) else list(by)
    cols = df.columns
    spread = checkpointed(df).repartitionByRange(*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order])
    placed = checkpointed(spread.withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_part"])
    return numbered.select(*cols, (F.col("_local") + F.col("_before")).alias(name))
