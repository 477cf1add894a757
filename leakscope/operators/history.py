"""Scan history and profile log: append-only tables with read views."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.operators.rollups import limit_per_group

HISTORY_LIMIT = 100
RECENT_LIMIT = 5


def user_history(history: DataFrame, user: str, n: int = HISTORY_LIMIT, tie: str = "id") -> DataFrame:
    """One user's newest scans. Filter plus top-k, no full sort."""
    return history.filter(F.col("user_email") == user).orderBy(F.desc("created_at"), F.desc(tie)).limit(n)


def newest_per_user(history: DataFrame, n: int = HISTORY_LIMIT, tie: str = "id") -> DataFrame:
    """Every user's newest n scans in one job."""
    return limit_per_group(history, "user_email", [F.desc("created_at"), F.desc(tie)], n)


def recent_scans(history: DataFrame, n: int = RECENT_LIMIT, tie: str = "id") -> DataFrame:
    return newest_per_user(history, n, tie)


def user_dashboard(history: DataFrame) -> DataFrame:
    """Per user: scans, findings, highest score (0 without any) and sources."""
    return history.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("total_scans"), F.sum("findings_count").alias("total_findings"),
        F.coalesce(F.max("max_ess"), F.lit(0.0)).alias("max_ess"), F.sum("sources_scanned").alias("sources_scanned"),
    )


def delete_history(history: DataFrame, user: str, ids: Sequence[int]) -> DataFrame:
    """History without the given rows of that user; rows of others stay, whatever their id.

    The id list comes with the request, so it is a plain filter that reaches the scan. For deletions held in a table
    use `delete_history_rows`.
    """
    return history.filter(~((F.col("user_email") == user) & F.col("id").isin(list(ids))))


def delete_history_rows(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Anti join with a table of (user_email, id) deletion requests."""
    return history.join(requests.select("user_email", "id").distinct(), ["user_email", "id"], "left_anti")


def missing_deletions(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that match no row of their own user (the caller answers "not found")."""
    return requests.join(history.select("user_email", "id"), ["user_email", "id"], "left_anti")


def latest_profiles(log: DataFrame, updated_at: str = "updated_at") -> DataFrame:
    """Current profile per user out of an append-only log: the upsert as a read view."""
    rest = [c for c in log.columns if c not in ("user_email", updated_at)]
    best = log.groupBy("user_email").agg(
        F.max(updated_at).alias(updated_at), F.max_by(F.struct(*rest), F.col(updated_at)).alias("_p")
    )
    return best.select("user_email", *[F.col(f"_p.{c}").alias(c) for c in rest], updated_at)


def last_scan(log: DataFrame, scanned_at: str = "scanned_at") -> DataFrame:
    """Latest stored scan per user."""
    return latest_profiles(log, scanned_at)


def users_overview(log: DataFrame, history: DataFrame, tie: str = "id") -> DataFrame:
    """Everybody who has a profile or a history: current profile, totals over all scans, and the newest scan.

    Profile, totals and newest scan are one row per user before they meet, so a user with very many scans is combined on the map side.
    """
    newest = history.groupBy("user_email").agg(F.max(F.struct("created_at", tie, "scan_type")).alias("_n"))
    both = user_dashboard(history).join(newest, "user_email")
    out = latest_profiles(log).join(both, "user_email", "full")
    return out.select(
        "user_email", *[c for c in log.columns if c not in ("user_email", "updated_at")], "updated_at",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_scans", "total_findings", "max_ess", "sources_scanned")],
        F.col(f"_n.{tie}").alias(f"last_{tie}"), F.col("_n.scan_type").alias("last_scan_type"), F.col("_n.created_at").alias("last_scan_at"),
    )
