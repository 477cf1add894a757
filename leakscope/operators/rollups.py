"""Rollups of findings and scans, first-N selections and set operations.

Every grouping is a hash aggregate with a map-side part, so a key that holds a large share of the rows is combined
before it is shuffled. Nothing is gathered into lists except bounded type names.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope import dims
from leakscope.functions import scoring as S
from leakscope.operators.numbering import checkpointed


def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def _milli(col: str = "confidence") -> Column:
    return (F.col(col).cast(S.CONF) * 1000).cast("bigint")


def _from_milli(col: Column, places: int = 3) -> Column:
    return (col.cast("decimal(18,0)") / 1000).cast(f"decimal(18,{places})").cast("double")


# --- distributions -----------------------------------------------------------------------------------------------


def risk_distribution(findings: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Findings per risk level with their share in percent (two places). Levels without findings count 0.

    One aggregation into four counters per group, then four rows out of each: no join with the level dimension.
    """
    keys = _keys(by)
    wide = findings.groupBy(*keys).agg(
        *[F.count_if(F.col("risk") == r).alias(r) for r in dims.RISK_LEVELS], F.count(F.lit(1)).alias("_all")
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("risk_rank"), F.lit(r).alias("risk"), F.col(r).alias("findings"))
        for i, r in enumerate(dims.RISK_LEVELS)
    ]))
    cents = F.when(F.col("_all") > 0, S.half_up(F.col("_r.findings") * 10000, F.col("_all"))).otherwise(F.lit(0))
    return wide.select(*keys, "_all", rows.alias("_r")).select(
        *keys, "_r.risk_rank", "_r.risk", "_r.findings",
        (cents.cast("decimal(12,0)") / 100).cast("decimal(7,2)").cast("double").alias("pct"),
    )


def type_distribution(findings: DataFrame, by: str | Sequence[str] | None = None, vocab: str = "as_is") -> DataFrame:
    """Count and average, lowest and highest confidence per type, with the rank by count (ties by type name).

    The rank is taken over the aggregated rows of a group, one per type.
    """
    keys = _keys(by)
    grouped = (
        findings.select(*keys, S.canonical_type(F.col("type"), vocab).alias("type"), _milli().alias("_m"))
        .groupBy(*keys, "type")
        .agg(F.count(F.lit(1)).alias("findings"), F.sum("_m").alias("_s"), F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    )
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("findings"), "type")
    return grouped.select(
        *keys, "type", "findings", _from_milli(S.half_up(F.col("_s"), F.col("findings"))).alias("avg_confidence"),
        _from_milli(F.col("_lo")).alias("min_confidence"), _from_milli(F.col("_hi")).alias("max_confidence"),
        F.row_number().over(order).alias("type_rank"),
    )


def top_type(findings: DataFrame, by: str | Sequence[str] | None = None, vocab: str = "as_is") -> DataFrame:
    """The most frequent type and its count; ties go to the alphabetically first."""
    keys = _keys(by)
    counts = findings.select(*keys, S.canonical_type(F.col("type"), vocab).alias("type")).groupBy(*keys, "type").count()
    # min over (-count, type) is a plain mergeable aggregate
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("type").alias("t"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.t").alias("type"), (-F.col("_b.n")).alias("findings")
    )


def confidence_bands(findings: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """High (from .80), medium (from .50), low; the average; findings without and with an annotation."""
    keys = _keys(by)
    m = F.col("_m")
    bare = F.coalesce(F.length("annotation"), F.lit(0)) == 0
    grouped = findings.select(*keys, "annotation", _milli().alias("_m")).groupBy(*keys).agg(
        F.count_if(m >= 800).alias("high"), F.count_if((m >= 500) & (m < 800)).alias("medium"),
        F.count_if(m < 500).alias("low"), F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("findings"),
        F.count_if(bare).alias("validated"), F.count_if(~bare).alias("annotated"),
    )
    avg = F.when(F.col("findings") > 0, S.half_up(F.col("_s"), F.col("findings")))
    return grouped.select(
        *keys, "findings", "high", "medium", "low", _from_milli(avg).alias("avg_confidence"), "validated", "annotated"
    )


def scan_combos(scored: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Distinct toxic combinations of a scan with their multiplier and the number of sources that show them."""
    keys = _keys(by)
    return (
        scored.filter(F.col("toxic_combo_label") != "none").groupBy(*keys, "toxic_combo_label")
        .agg(F.max("toxic_multiplier").alias("toxic_multiplier"), F.count(F.lit(1)).alias("sources"))
    )


# --- alert batches -----------------------------------------------------------------------------------------------


def alert_summary(findings: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Total, critical, high and medium findings (low ones count in the total only)."""
    counters = [F.count_if(F.col("risk") == r).alias(r.lower()) for r in dims.RISK_LEVELS[:3]]
    return findings.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("total"), *counters)


def alert_sample(findings: DataFrame, n: int = 10, order: str = "risk", arrival: str = "detected_at") -> DataFrame:
    """The n findings an alert shows: most severe first, or in arrival order (`order="arrival"`). A top-k plan."""
    if order == "risk":
        return findings.orderBy(S.risk_rank(F.col("risk")), F.desc("confidence"), "type", "value", arrival).limit(n)
    if order == "arrival":
        return findings.orderBy(arrival, "type", "value").limit(n)
    raise ValueError("order must be 'risk' or 'arrival'")


def first_per_value(findings: DataFrame, order: Sequence[str], keys: Sequence[str] = ("type", "value")) -> DataFrame:
    """The first finding of every (type, value). A min over a struct, which combines on the map side."""
    rest = [c for c in findings.columns if c not in keys and c not in order]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_rest") if rest else None
    aggs = [F.min(F.struct(*order)).alias("_o")] + ([packed] if packed is not None else [])
    out = findings.groupBy(*keys).agg(*aggs)
    cols = {c: F.col(c) for c in keys} | {c: F.col(f"_o.{c}") for c in order} | {c: F.col(f"_rest.{c}") for c in rest}
    return out.select(*[cols[c].alias(c) for c in findings.columns])


# --- first N per group -------------------------------------------------------------------------------------------

# up to this many rows Spark itself cuts every group before the shuffle (its WindowGroupLimit threshold)
GROUP_LIMIT_PUSHED = 1000
# and up to this many rows one task orders a group's first rows
RANGE_LIMIT = 100_000
SALTS = 64


def limit_per_group(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], n: int | None) -> DataFrame:
    """First n rows of each group in the given order, which should be total; all rows if n is None.

    A rank filter: each task keeps at most n rows of a group before the shuffle. For large n, where Spark does not do
    that by itself, groups are first cut inside salted parts, then once more; beyond RANGE_LIMIT they are cut by ranges, without a
    task that sees n rows.
    """
    if n is None:
        return df
    if n > RANGE_LIMIT:
        return first_by_range(df, keys, order, n)
    names = _keys(keys)
    if n > GROUP_LIMIT_PUSHED:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
        inner = Window.partitionBy(*names, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(inner)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    window = Window.partitionBy(*names).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def first_by_range(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows of each group in the given order, which should be total, for n of any size.

    Rows are dealt out by ranges of (group, order), so a hot group spreads over many tasks in its order. Counts per task and group, one
    row each, say which tasks hold only rows within the first n, which none, and in which one the cut lies; only there rows are numbered.
    """
    names = _keys(keys)
    by = [F.col(k) for k in names]
    placed = checkpointed(df.repartitionByRange(*by, *[F.col(o) if isinstance(o, str) else o for o in order]).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("_room", F.lit(n) - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_room") > 0)
    named = room.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)], F.col("_part").alias("_p"), "_n", "_room")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(names):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    held = placed.join(named, on)
    whole = held.filter(F.col("_n") <= F.col("_room"))
    local = Window.partitionBy("_part", *names).orderBy(*order)
    cut = held.filter(F.col("_n") > F.col("_room")).withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") <= F.col("_room"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


# --- scans, sessions ---------------------------------------------------------------------------------------------


def session_totals(leaks: DataFrame, platforms: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Files and findings per (session, platform) and per session (platform null), with ESS extremes per session.

    `platforms` holds the landed file counts, `leaks` one row per finding, `scored` one score per session and source.
    """
    found = leaks.groupBy("session_id", "platform").agg(F.count(F.lit(1)).alias("_found"))
    files = platforms.groupBy("session_id", "platform").agg(F.sum("file_count").alias("_files"))
    both = files.join(found, ["session_id", "platform"], "full")
    zero = F.lit(0).cast("bigint")
    rolled = both.rollup("session_id", "platform").agg(
        F.sum(F.coalesce("_files", zero)).alias("total_files"), F.sum(F.coalesce("_found", zero)).alias("total_findings")
    ).filter(F.col("session_id").isNotNull())
    if scored is None:
        return rolled
    extremes = scan_summary_numbers(scored, "session_id")
    return rolled.join(extremes, "session_id", "left")


def scan_summary_numbers(scored: DataFrame, by: str | Sequence[str]) -> DataFrame:
    keys = _keys(by)
    cents = (F.col("score").cast("decimal(4,2)") * 100).cast("bigint")
    grouped = scored.select(*keys, cents.alias("_c")).groupBy(*keys).agg(
        F.max("_c").alias("_hi"), F.sum("_c").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    two = lambda c: (c.cast("decimal(12,0)") / 100).cast("decimal(12,2)").cast("double")
    return grouped.select(
        *keys, two(F.col("_hi")).alias("max_ess"), two(S.half_up(F.col("_s"), F.col("_n"))).alias("avg_ess")
    )


def session_star(spark: SparkSession, path: str, sessions: Column | None = None, by: str = "scan_id") -> DataFrame:
    """Per session and platform of the scans stored under `path` (`sinks.write_scan`): files, findings by risk, highest score.

    `sessions` chooses sessions by their columns. Findings and scores are stored in a folder per session, and the choice decides
    while the query runs which of them are read. Both are summed before they meet the platforms, so no finding is shuffled but as a sum.
    """
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in ("scan_sessions", "platforms", "leak_records", "ess_records")}
    chosen = stored["scan_sessions"] if sessions is None else stored["scan_sessions"].filter(sessions)
    keys = chosen.select(by).distinct()
    risks = [F.count_if(F.col("risk") == r).alias(r.lower()) for r in dims.RISK_LEVELS]
    found = stored["leak_records"].join(keys, by, "left_semi").groupBy(by, "platform").agg(F.count(F.lit(1)).alias("findings"), *risks)
    scores = stored["ess_records"].join(keys, by, "left_semi").groupBy(by, "platform").agg(F.max("score").alias("max_ess"))
    files = stored["platforms"].join(keys, by, "left_semi").groupBy(by, "platform").agg(F.sum("file_count").alias("files"))
    both = files.join(found, [by, "platform"], "left").join(scores, [by, "platform"], "left").fillna(0, ["findings", *(r.lower() for r in dims.RISK_LEVELS)])
    return chosen.drop("scan_date").join(both, by)


def combine_scans(a: DataFrame, b: DataFrame, by: str | Sequence[str] = "scan_id", avg: str = "as_is") -> DataFrame:
    """Merge two scan summaries: higher maximum with its label and colour (the first on ties), summed sources, united
    types. The average is the mean of both averages with a missing side as 0 (`as_is`), or weighted by the number of
    sources (`weighted`). Optional columns total_sources_scanned (summed) and scan_duration (longer one) are kept.
    """
    if avg not in ("as_is", "weighted"):
        raise ValueError("avg must be 'as_is' or 'weighted'")
    keys = _keys(by)
    extra = [c for c in ("total_sources_scanned", "scan_duration") if c in a.columns and c in b.columns]
    cols = [*keys, "max_ess", "avg_ess", "label", "color", "total_sources", "all_types", *extra]
    both = a.select(*cols, F.lit(0).alias("_side")).unionByName(b.select(*cols, F.lit(1).alias("_side")))
    cents = (F.col("avg_ess").cast("decimal(6,2)") * 100).cast("bigint")
    unrolled = both.select(*cols, "_side", cents.alias("_c"), F.posexplode_outer("all_types").alias("_pos", "_type"))
    head = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    only = lambda c: F.when(head, c)
    grouped = unrolled.groupBy(*keys).agg(
        F.min(F.struct((-F.col("max_ess")).alias("m"), F.col("_side").alias("s"), F.col("label"), F.col("color"))).alias("_best"),
        F.sum(only(F.col("_c"))).alias("_c"), F.sum(only(F.col("_c") * F.col("total_sources"))).alias("_w"),
        F.sum(only(F.col("total_sources"))).alias("total_sources"),
        F.array_sort(F.collect_set("_type")).alias("all_types"),
        *([F.sum(only(F.col("total_sources_scanned"))).alias("total_sources_scanned")] if "total_sources_scanned" in extra else []),
        *([F.max("scan_duration").alias("scan_duration")] if "scan_duration" in extra else []),
    )
    if avg == "as_is":
        mean = (F.col("_c").cast("decimal(12,0)") / 200).cast("decimal(12,3)").cast("double")
    else:
        mean = (S.half_up(F.col("_w"), F.col("total_sources")).cast("decimal(12,0)") / 100).cast("decimal(12,2)").cast("double")
    return grouped.select(
        *keys, (-F.col("_best.m")).alias("max_ess"), mean.alias("avg_ess"), F.col("_best.label").alias("label"),
        F.col("_best.color").alias("color"), "total_sources", "all_types", *extra,
    )


# --- set operations ----------------------------------------------------------------------------------------------


def union_findings(*frames: DataFrame) -> DataFrame:
    """Findings of several sources; columns a source lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def type_union(*cols: Column) -> Column:
    """Sorted distinct union of type arrays; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(reduce(F.array_union, [F.coalesce(c, empty) for c in cols]))


def by_confidence(findings: DataFrame) -> DataFrame:
    """Findings by confidence, highest first, with a total tie order."""
    ties = [c for c in ("doc_id", "start", "type", "value") if c in findings.columns]
    return findings.orderBy(F.desc("confidence"), *ties)
