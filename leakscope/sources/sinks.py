"""Tables a scan writes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.operators.links import with_cluster_id
from leakscope.operators.numbering import checkpointed


def leak_records(findings: DataFrame) -> DataFrame:
    """Findings as stored records: masked value and link hash, never the raw value or the raw snippet. Findings of a scan with
    `masked` keep their masked snippet, others have none."""
    safe = F.col("masked_snippet") if "masked_snippet" in findings.columns else F.lit(None).cast("string")
    return with_cluster_id(findings).withColumn("snippet", safe).withColumnsRenamed(
        {"type": "entity_type", "start": "char_start", "end": "char_end"}
    ).drop("value", "masked_snippet")


def write_scan(findings: DataFrame, ess: DataFrame, path: str, scan_date, sessions: DataFrame | None = None,
               platforms: DataFrame | None = None) -> None:
    """Session, platform, leak and score tables under one folder, partitioned by scan date and scan.

    Only the scans that are written are replaced: others of the same day stay, and a repeated write leaves one copy.
    """
    tables = {"leak_records": leak_records(findings), "ess_records": ess}
    if sessions is not None:
        tables["scan_sessions"] = sessions
    if platforms is not None:
        tables["platforms"] = platforms
    for name, df in tables.items():
        (
            df.withColumn("scan_date", F.lit(scan_date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("scan_date", *[c for c in ("scan_id",) if c in df.columns]).parquet(f"{path}/{name}")
        )


def append_history(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append scan results; created_at defaults to now. With `batch` (a name for this run), a repeated write replaces the rows
    that an earlier one left, and `id` is made from batch, user and target where rows have none."""
    now = F.current_timestamp()
    stamp = F.coalesce(F.col("created_at"), now) if "created_at" in rows.columns else now
    out = rows.withColumn("created_at", stamp)
    if batch is None:
        out.write.mode("append").parquet(path)
        return
    if "id" not in out.columns:
        named = [F.col(c).cast("string") for c in ("user_email", "target") if c in out.columns]
        out = out.withColumn("id", F.xxhash64(F.lit(batch), *named))
    out.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_report(fragments: DataFrame, path: str, by: str = "scan_id") -> None:
    """HTML text files, one folder per scan. Files of a folder read in name order give the document. The fragments are made once:
    their ranges are sampled from what has been written."""
    ordered = checkpointed(fragments).repartitionByRange(by, "section", "row_no").sortWithinPartitions(by, "section", "row_no")
    ordered.select(by, "html").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(path)


def write_paths(files: DataFrame, path: str) -> None:
    """The list of exposed paths of every repository as text files, one folder per repository."""
    ordered = checkpointed(files).repartitionByRange("repo", "path").sortWithinPartitions("repo", "path")
    ordered.select("repo", F.col("path").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").text(path)
