"""Exposure severity score: findings -> one score per source -> one summary per scan.

All arithmetic is exact (integers and decimals, half up), so a result does not depend on the order of rows. Grouping
keys may be hot: every aggregate combines on the map side and the only collected sets hold type names.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions import scoring as S


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ess(
    findings: DataFrame, source_key: str | Sequence[str] = "source_key", source_type: str = "source_type",
    vocab: str = "canonical",
) -> DataFrame:
    """Score per source. `source_type` names a column that is constant within a source (github_public, pastebin, ...).

    base = highest type weight; times the strongest toxic combination; times the exposure radius; minus
    round((1 - average confidence) * 1.5, 3); clamped to 0..10 and rounded to two places.
    """
    keys = _keys(source_key)
    typed = findings.select(
        *keys, F.col(source_type).alias("_source_type"), S.canonical_type(F.col("type"), vocab).alias("_type"),
        (F.col("confidence").cast(S.CONF) * 1000).cast("bigint").alias("_milli"),
    )
    grouped = typed.groupBy(*keys).agg(
        F.max("_source_type").alias("_source_type"),
        F.max(S.sensitivity(F.col("_type"))).alias("_base"),
        F.array_sort(F.collect_set("_type")).alias("types_found"),
        F.sum("_milli").alias("_sum"),
        F.count(F.lit(1)).alias("findings_count"),
    )
    n, total = F.col("findings_count"), F.col("_sum")
    # thousandths, half up: (1 - total / 1000n) * 1500 = (1000n - total) * 3 / 2n
    penalty_milli = S.half_up((n * 1000 - total) * 3, n * 2)
    scored = (
        grouped.withColumn("_toxic", S.toxic_combo(F.col("types_found")))
        .withColumn("_radius", S.exposure_radius(F.col("_source_type")))
        .withColumn("_penalty", (penalty_milli.cast("decimal(12,0)") / 1000).cast("decimal(12,3)"))
        .withColumn("_after_toxic", (F.col("_base") * F.col("_toxic.multiplier")).cast("decimal(10,3)"))
        .withColumn("_after_radius", (F.col("_after_toxic") * F.col("_radius")).cast("decimal(14,5)"))
    )
    raw = (F.col("_after_radius") - F.col("_penalty")).cast("decimal(14,5)")
    bounded = F.greatest(F.lit("0").cast("decimal(14,5)"), F.least(F.lit("10").cast("decimal(14,5)"), raw))
    final = F.round(bounded, 2).cast("decimal(4,2)")
    as_double = lambda c: c.cast("double")
    return scored.withColumn("_score", final).select(
        *keys, F.col("_source_type").alias("source_type"),
        as_double(F.col("_score")).alias("score"), as_double(F.col("_base")).alias("base_score"),
        F.col("_toxic.label").alias("toxic_combo_label"),
        as_double(F.col("_toxic.multiplier")).alias("toxic_multiplier"),
        as_double(F.col("_radius")).alias("exposure_multiplier"),
        as_double(F.col("_penalty")).alias("confidence_penalty"),
        "types_found",
        F.struct(
            as_double(F.col("_base")).alias("base_score"),
            as_double(F.round("_after_toxic", 3)).alias("after_toxic_combo"),
            as_double(F.round("_after_radius", 3)).alias("after_exposure"),
            as_double(F.col("_penalty")).alias("confidence_penalty"),
            as_double(F.col("_score")).alias("final_score"),
        ).alias("breakdown"),
        S.ess_label(F.col("_score")).alias("ess_label"), S.ess_color(F.col("_score")).alias("ess_color"),
        "findings_count",
    )


def ess_of_all(sources: DataFrame, scored: DataFrame, source_key: str | Sequence[str] = "source_key") -> DataFrame:
    """Every listed source, those without findings with score 0, label "none" for the combination and no types."""
    keys = _keys(source_key)
    joined = sources.select(*keys).distinct().join(scored, keys, "left")
    zero, one = F.lit(0.0), F.lit(1.0)
    return joined.select(
        *keys, F.coalesce("score", zero).alias("score"), F.coalesce("base_score", zero).alias("base_score"),
        F.coalesce("toxic_combo_label", F.lit("none")).alias("toxic_combo_label"),
        F.coalesce("toxic_multiplier", one).alias("toxic_multiplier"),
        F.coalesce("exposure_multiplier", one).alias("exposure_multiplier"),
        F.coalesce("confidence_penalty", zero).alias("confidence_penalty"),
        F.coalesce("types_found", F.array().cast("array<string>")).alias("types_found"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
    )


def scan_summary(scored: DataFrame, by: str | Sequence[str] = "scan_id") -> DataFrame:
    """Per scan: highest and average score, label and colour of the highest, number of scored sources, sorted types.

    One shuffle: each source is unrolled into its types, and only the first unrolled row counts for the scores.
    """
    keys = _keys(by)
    unrolled = scored.select(
        *keys, F.col("score").cast("decimal(4,2)").alias("_score"), F.posexplode_outer("types_found").alias("_pos", "_type")
    )
    head = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    grouped = unrolled.groupBy(*keys).agg(
        F.max("_score").alias("_max"),
        F.sum(F.when(head, F.col("_score"))).alias("_sum"),
        F.count_if(head).alias("total_sources"),
        F.array_sort(F.collect_set("_type")).alias("all_types"),
    )
    # hundredths, half up
    cents = (F.col("_sum") * 100).cast("bigint")
    avg_cents = S.half_up(cents, F.col("total_sources"))
    return grouped.select(
        *keys, F.col("_max").cast("double").alias("max_ess"),
        (avg_cents.cast("decimal(12,0)") / 100).cast("decimal(12,2)").cast("double").alias("avg_ess"),
        S.ess_label(F.col("_max")).alias("label"), S.ess_color(F.col("_max")).alias("color"),
        "total_sources", "all_types",
    )


def summary_or_empty(summary: DataFrame, scans: DataFrame, by: str | Sequence[str] = "scan_id",
                     empty_label: str = dims.ESS_FLOOR[0]) -> DataFrame:
    """A row for every scan; those without a scored source get 0 / 0 / INFO (profile scans use NONE)."""
    keys = _keys(by)
    zero = F.lit(0.0)
    return scans.select(*keys).distinct().join(summary, keys, "left").select(
        *keys, F.coalesce("max_ess", zero).alias("max_ess"), F.coalesce("avg_ess", zero).alias("avg_ess"),
        F.coalesce("label", F.lit(empty_label)).alias("label"),
        F.coalesce("color", F.lit(dims.ESS_FLOOR[1])).alias("color"),
        F.coalesce("total_sources", F.lit(0)).alias("total_sources"),
        F.coalesce("all_types", F.array().cast("array<string>")).alias("all_types"),
    )


def source_key(scan_type: str) -> Column:
    """What counts as one source, per kind of scan."""
    keys = {
        "repo": F.col("path"), "user_repos": F.col("container"), "pastes": F.col("path"),
        "forum": F.concat(F.lit("forum/"), F.col("container")),
        "channel": F.concat(F.lit("channel/"), F.col("container")),
        "profile": F.concat_ws("/", F.col("platform"), F.col("container")),
    }
    if scan_type not in keys:
        raise ValueError(f"unknown scan type {scan_type!r}")
    return keys[scan_type]


def sources_scanned(documents: DataFrame, key: str | Sequence[str], by: str | Sequence[str] = "scan_id") -> DataFrame:
    """Number of distinct sources looked at per scan, with or without findings (two-step, so a hot scan is no problem)."""
    keys = _keys(by)
    return (
        documents.select(*keys, *_keys(key)).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("total_sources_scanned"))
    )
