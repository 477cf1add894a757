"""Alerts over a stream of landed documents.

landing folder -> target filter -> scan (the batch operator, unchanged) -> watermark -> dedupe per identifier ->
tumbling windows. State keys are hashes, so no raw value is kept in state.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leakscope.functions.scoring import risk_rank
from leakscope.operators.detect import scan
from leakscope.operators.rollups import alert_summary, first_per_value
from leakscope.sources.versions import Folder
from leakscope.streaming.memory import new_since_last

LANDED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("target", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("landed_at", T.TimestampType()),
])
SALTS = 16
SAMPLE = 10


def landed_documents(spark: SparkSession, folder: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Stream of landed documents. Unreadable JSON rows keep their raw text in `_corrupt` instead of failing the query."""
    schema = LANDED
    reader = spark.readStream.schema(schema)
    if fmt == "json":
        schema = T.StructType([*LANDED.fields, T.StructField("_corrupt", T.StringType())])
        reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(folder)


def targets_table(spark: SparkSession, repos: Sequence[str] = (), pastes: bool = True, channels: Sequence[str] = ()) -> DataFrame:
    """Configuration as rows (kind, target). A null target admits every source of the kind."""
    rows = [("github", r) for r in repos] + [("telegram", c) for c in channels] + ([("pastebin", None)] if pastes else [])
    return spark.createDataFrame(rows, "kind string, target string")


def for_targets(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of configured targets (stream-static semi join; Spark chooses the join by the size of the table)."""
    wanted = targets.select(F.col("kind").alias("_kind"), F.col("target").alias("_target"))
    kinds = wanted.filter(F.col("_target").isNull()).select("_kind").distinct().withColumn("_open", F.lit(True))
    named = wanted.filter(F.col("_target").isNotNull()).distinct().withColumn("_named", F.lit(True))
    out = documents.join(kinds, F.col("kind") == F.col("_kind"), "left").drop("_kind")
    out = out.join(named, (F.col("kind") == F.col("_kind")) & (F.col("target") == F.col("_target")), "left")
    return out.filter(F.col("_open") | F.col("_named")).drop("_kind", "_target", "_open", "_named")


def unreadable(documents: DataFrame) -> DataFrame:
    """Error rows: what could not be parsed, per target, instead of an aborted query."""
    raw = F.col("_corrupt") if "_corrupt" in documents.columns else F.lit(None).cast("string")
    bad = raw.isNotNull() | F.col("text").isNull() | F.col("landed_at").isNull()
    return documents.filter(bad).select(
        F.lit("error").alias("type"), "kind", "target", "path",
        F.concat(F.lit("Scan failed: "), F.when(raw.isNotNull(), "unreadable record")
                 .when(F.col("text").isNull(), "no content").otherwise("no landing time")).alias("message"),
    )


def readable(documents: DataFrame) -> DataFrame:
    good = F.col("text").isNotNull() & F.col("landed_at").isNotNull()
    if "_corrupt" in documents.columns:
        good = good & F.col("_corrupt").isNull()
    return documents.filter(good).drop("_corrupt")


def tagged_findings(documents: DataFrame, profile: str = "context", scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Findings with source, source_url and detected_at (event time); the same call serves batch and stream."""
    tagged = documents.select(
        F.concat("kind", F.lit(":"), "target").alias("source"), F.col("url").alias("source_url"),
        F.col("landed_at").alias("detected_at"), "path", "text",
    )
    return scan(tagged, profile, scorer=scorer, filename="path", masked=True)


def new_findings(findings: DataFrame, horizon: str = "1 day") -> DataFrame:
    """First occurrence of every (type, value) within the horizon, across micro-batches.

    Two steps, so that a value seen in a large share of the rows does not meet one task: first per salt, then overall.
    """
    keyed = findings.withColumns({
        "value_key": F.sha2(F.concat("type", F.lit(":"), "value"), 256),
        "_salt": F.pmod(F.xxhash64("source", "path", "start"), F.lit(SALTS)).cast("int"),
    }).withWatermark("detected_at", horizon)
    per_salt = keyed.dropDuplicatesWithinWatermark(["value_key", "_salt"])
    return per_salt.dropDuplicatesWithinWatermark(["value_key"]).drop("_salt")


def alert_windows(findings: DataFrame, width: str = "300 seconds", slide: str | None = None) -> DataFrame:
    """Total, critical, high and medium findings per tumbling (or sliding) window of event time."""
    win = F.window("detected_at", width, slide) if slide else F.window("detected_at", width)
    return alert_summary(findings.withColumn("_w", win), "_w").select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "total", "critical", "high", "medium"
    )


def alert_sessions(events: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Runs of events with at most `gap_seconds` between neighbours, per key: start, last event, count (as session_window).

    Events of one slot as wide as the gap always belong together, so they are first combined per (key, slot) on the map
    side. Only slots are ordered per key, and their number depends on the time range, not on the number of events.
    """
    kind = events.schema[ts].dataType  # with or without time zone, out as it came in
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = (
        events.filter(F.col(ts).isNotNull()).select(*keys, micros.alias("_t")).withColumn("_slot", F.call_function("div", "_t", F.lit(gap)))
        .groupBy(*keys, "_slot").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(*keys).orderBy("_slot")
    fresh = F.coalesce((F.col("_lo") - F.lag("_hi").over(order) > gap).cast("int"), F.lit(1))
    numbered = slots.withColumn("_new", fresh).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_run").agg(
        F.timestamp_micros(F.min("_lo")).cast(kind).alias("session_start"), F.timestamp_micros(F.max("_hi")).cast(kind).alias("last_event"),
        F.sum("_n").alias("events"),
    ).drop("_run")


def stream_sessions(findings: DataFrame, gap: str = "30 minutes", keys: Sequence[str] = ("type",)) -> DataFrame:
    """Session windows for a stream. Set spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition to true so
    that sessions are merged before the shuffle."""
    return findings.groupBy(*keys, F.session_window("detected_at", gap).alias("_w")).agg(F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "events"
    )


def alert_batch(findings: DataFrame, n: int = SAMPLE) -> DataFrame:
    """One alert row for a batch of findings: counts and the n most severe as an array (a top-k, then n rows together)."""
    counters = ["total", "critical", "high", "medium"]
    totals = alert_summary(findings)
    fields = ["type", "value_masked", "risk", "confidence", "source", "source_url", "detected_at"]
    rank = risk_rank(F.col("risk"))
    top = findings.orderBy(rank, F.desc("confidence"), "type", "value_masked", "source", "detected_at").limit(n)
    shown = top.select(F.struct(rank.alias("rank"), (-F.col("confidence")).alias("c"), *fields).alias("_s"))
    # one row of totals and at most n sample rows fold into the alert row
    both = totals.unionByName(shown, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in counters], F.array_sort(F.collect_list("_s")).alias("_s"))
    sample = F.transform("_s", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return both.filter(F.col("total") > 0).select(
        F.lit("alert_batch").alias("type"), *counters, F.size("_s").alias("sample_size"), sample.alias("findings"))


class AlertQueries(NamedTuple):
    """The running scan and, if asked for, the query that collects unreadable rows."""

    found: StreamingQuery
    errors: StreamingQuery | None

    def stop(self) -> None:
        for q in self:
            if q is not None:
                q.stop()

    def awaitTermination(self, timeout: float | None = None) -> None:  # noqa: N802  like a query's
        for q in self:
            if q is not None:
                q.awaitTermination(timeout) if timeout is not None else q.awaitTermination()


class AlertSink:
    """Findings and alert row of each batch, which count from the moment their commit file is there.

    A batch that is repeated after a stop overwrites what it had written without a commit; one that was committed is left alone. Readers go
    by the commits (`committed`), so a batch is seen whole or not at all.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.out, self._commits = out, Folder(spark, f"{out}/commits")

    def _name(self, batch_id: int) -> str:
        return f"{batch_id:012d}.json"

    def __call__(self, findings: DataFrame, batch_id: int) -> None:
        if self._name(batch_id) in self._commits.names():
            return
        self.write_findings(findings, batch_id)
        self.write_alert(self.written_findings(findings, batch_id), batch_id)
        self.commit(batch_id)

    def write_findings(self, findings: DataFrame, batch_id: int) -> None:
        findings.write.mode("overwrite").parquet(f"{self.out}/findings/batch_id={batch_id}")

    def written_findings(self, findings: DataFrame, batch_id: int) -> DataFrame:
        """The batch as it lies in its folder. An alert row reads it twice, and a stream's batch would be made anew for that, with its
        steps through the state."""
        return findings.sparkSession.read.schema(findings.schema).parquet(f"{self.out}/findings/batch_id={batch_id}")

    def write_alert(self, findings: DataFrame, batch_id: int) -> None:
        alert_batch(findings).write.mode("overwrite").parquet(f"{self.out}/alerts/batch_id={batch_id}")

    def commit(self, batch_id: int) -> None:
        self._commits.put_new(self._name(batch_id), f'{{"batch_id": {batch_id}}}')


def committed(spark: SparkSession, out: str, what: str) -> DataFrame:
    """`findings` or `alerts` of all batches that an alert stream has ended, with their batch_id."""
    done = spark.read.schema("batch_id long").json(f"{out}/commits")
    rows = spark.read.parquet(f"{out}/{what}")
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(done, "batch_id", "left_semi")


def alert_stream(spark: SparkSession, landing: str, targets: DataFrame | None, out: str, checkpoint: str,
                 interval: str = "300 seconds", horizon: str = "1 day", profile: str = "context", fmt: str = "json",
                 scorer: Callable[[Column], Column] | None = None, once: bool = False, errors: str | None = None,
                 max_files: int | None = None, again_after: str | None = None, stored: DataFrame | None = None,
                 sink: Callable[[DataFrame, int], None] | None = None) -> AlertQueries:
    """Start the recurring scan. Every micro-batch writes new findings and one alert row under its batch number and commits both
    together (`AlertSink`, read with `committed`). `once` processes what is there and ends. `errors` names a folder for rows that
    can't be read; they are a query of their own. Both end with `stop()`.

    A value alerts once within the horizon. With `again_after` it alerts once, over all runs on this checkpoint and the `stored` leak
    records, and again when that time has passed since (`memory.new_since_last`, in a `memory.state_session`).
    """
    landed = landed_documents(spark, landing, fmt, max_files)
    docs = readable(landed)
    docs = docs if targets is None else for_targets(docs, targets)
    tagged = tagged_findings(docs, profile, scorer)
    fresh = new_findings(tagged, horizon) if again_after is None else new_since_last(tagged, again_after, stored, horizon)
    sink = AlertSink(spark, out) if sink is None else sink

    def emit(batch: DataFrame, batch_id: int) -> None:
        kept = first_per_value(batch, ["detected_at", "source", "path", "start"], ["type", "value"])
        kept = kept.persist()
        try:
            # neither the value nor a snippet that shows any value leaves the query
            sink(kept.withColumn("snippet", F.col("masked_snippet")).drop("value", "masked_snippet"), batch_id)
        finally:
            kept.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": interval}
    failed = None
    if errors is not None:
        side = unreadable(landed).writeStream.format("json").option("path", errors).option("checkpointLocation", f"{checkpoint}/errors")
        failed = side.outputMode("append").trigger(**trigger).start()
    found = (
        fresh.writeStream.foreachBatch(emit).outputMode("append").option("checkpointLocation", f"{checkpoint}/alerts")
        .trigger(**trigger).start()
    )
    return AlertQueries(found, failed)
