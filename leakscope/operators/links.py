"""Links across sources: the same identifier seen on more than one platform."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.scoring import canonical_type


def normalised_value(type_col: Column, value: Column) -> Column:
    """Separators and case removed; telephone numbers lose a leading 91 that makes them twelve digits."""
    bare = F.lower(F.regexp_replace(value, r"(?U)[\s\-]", ""))
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    phone = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(type_col == "PHONE_NUMBER_INDIA", phone).otherwise(bare)


def cluster_id(type_col: Column, value: Column) -> Column:
    return F.sha2(F.concat(type_col, F.lit("|"), normalised_value(type_col, value)), 256)


def with_cluster_id(findings: DataFrame) -> DataFrame:
    """Findings with the identifier hash that links them (no raw value needed downstream)."""
    kind = canonical_type(F.col("type"))
    return findings.withColumn("identity_cluster_id", cluster_id(kind, F.col("value")))


def identity_links(findings: DataFrame, platform: str = "platform", min_platforms: int = 2) -> DataFrame:
    """Identifiers found on at least `min_platforms` platforms, with counts.

    Two aggregations, no self-join: first per identifier and platform, then per identifier. A value that occurs in a
    third of all rows is a handful of rows after the map-side part of the first step.
    """
    kind = canonical_type(F.col("type"))
    per_platform = (
        findings.select(kind.alias("type"), cluster_id(kind, F.col("value")).alias("cluster_id"), F.col(platform).alias("_p"))
        .groupBy("type", "cluster_id", "_p").agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        per_platform.groupBy("type", "cluster_id")
        .agg(F.count("_p").alias("platforms"), F.sum("_n").alias("findings"),
             F.min("_p").alias("first_platform"), F.max("_p").alias("last_platform"))
        .filter(F.col("platforms") >= min_platforms)
    )
