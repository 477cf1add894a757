"""Queries over what scans leave behind: state between runs, stored history, committed batches."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakscope import dims
from leakscope.operators import context as X
from leakscope.operators import history as H
from leakscope.operators.detect import scan
from leakscope.operators.fakefilter import filter_fake
from leakscope.operators.numbering import checkpointed, shared_folder
from leakscope.operators.rollups import session_star as session_star_of
from leakscope.operators.rollups import session_totals, type_union
from leakscope.operators.scores import KeptScores
from leakscope.plans import detection_queries as D
from leakscope.plans import oracle_sql as O
from leakscope.plans import scans as P
from leakscope.plans import source_queries as Q
from leakscope.plans.registry import corpus_findings, dbl, joined, query, table
from leakscope.sources import landed as J
from leakscope.sources.layout import land_bucketed
from leakscope.sources.sinks import append_history, leak_records, write_scan
from leakscope.sources.versions import Folder, VersionedTable
from leakscope.streaming import alerts as A
from leakscope.streaming import memory as M
from leakscope.streaming import sessions as N


def _new_folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- new since the last scan -------------------------------------------------------------------------------------

#: Events up to the first moment were found by batch scans, those up to the second by the first run of the stream.
STORED_UNTIL, FIRST_UNTIL, AGAIN, AGAIN_S = "2024-01-08", "2024-01-18", "5 days", 432000

_SAME = "L.type = A.type and L.value = A.value"


@query("stream_new_since_last", f"""with recursive S as (select event_type as type, cast(user_id as varchar) as value, ts, cast(floor(epoch(ts)) as bigint) as s from events),
B as (select type, value, max(s) as last from S where ts < timestamp '{STORED_UNTIL}' group by type, value),
L as (select type, value, s, min(ts) as ts from S where ts >= timestamp '{STORED_UNTIL}' group by type, value, s),
A as (select L.type, L.value, min(L.s) as s from L left join B on B.type = L.type and B.value = L.value where last is null or L.s >= last + {AGAIN_S} group by L.type, L.value
 union all select A.type, A.value, min(L.s) from A join L on {_SAME} and L.s >= A.s + {AGAIN_S} group by A.type, A.value)
select case when ts < timestamp '{FIRST_UNTIL}' then 1 else 2 end as run, A.type, A.value, ts as detected_at from A join L on {_SAME} and L.s = A.s""")
def stream_new_since_last(spark, sf):
    """Two runs of a stream on one checkpoint, each in a session of its own, after scans whose records are stored: an identifier
    alerts once, and again five days after its last alert, whichever run that was in."""
    found = Q._alerts(spark, sf).select("type", "value", "risk", "detected_at")
    folder, at, kind = _new_folder(spark, "new-since-last"), F.col("detected_at"), found.schema["detected_at"].dataType
    before = [at < F.lit(day).cast(kind) for day in (STORED_UNTIL, FIRST_UNTIL)]
    leak_records(found.filter(before[0])).select(M.KEY, "detected_at").write.parquet(f"{folder}/leak_records")
    runs = [~before[0] & before[1], ~before[1]]
    for n, part in enumerate(runs, 1):
        found.filter(part).write.mode("append").parquet(f"{folder}/landing")
        session = M.state_session(spark)
        landed = session.readStream.schema(found.schema).parquet(f"{folder}/landing").withColumn("detected_at", at.cast("timestamp"))
        new = M.new_since_last(landed, AGAIN, session.read.parquet(f"{folder}/leak_records")).withColumn("run", F.lit(n))
        q = (new.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/alerts")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    alerts = spark.read.schema(new.schema).parquet(f"{folder}/alerts")
    return alerts.select("run", "type", "value", at.cast(kind).alias("detected_at"))


# --- stored history ----------------------------------------------------------------------------------------------

HISTORY = "user_email string, id long, scan_type string, findings_count int, max_ess double, sources_scanned int, created_at timestamp"


@query("history_rewritten", f"""with asked as (select o_orderkey as id, concat('u', o_custkey - o_orderkey % 2) as user_email from orders where o_orderkey % 3 = 0),
kept as (select h.* from {Q.HIST} h where not exists (select 1 from asked a where a.id = h.id and a.user_email = h.user_email)),
changed as (select * replace (cast(99 as int) as findings_count) from {Q.HIST} where id % 5 = 0),
after as (select * from kept where id % 5 <> 0 union all select * from changed)
select user_email, id, findings_count, max_ess from (select *, row_number() over (partition by user_email order by created_at desc, id desc) as rn from after) where rn <= 100""")
def history_rewritten(spark, sf):
    """Stored history after a load, a deletion and an upsert, each of them run twice, read back by user."""
    history = Q._history(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stored = VersionedTable(spark, _new_folder(spark, "history"), HISTORY, "user_email", 16)
    asked = history.filter(F.col("id") % 3 == 0).select(
        F.concat(F.lit("u"), (F.substring("user_email", 2, 20).cast("long") - F.col("id") % 2).cast("string")).alias("user_email"), "id")
    changed = history.filter(F.col("id") % 5 == 0).withColumn("findings_count", F.lit(99))
    for _ in range(2):
        stored.append(history, "load")
        stored.delete(asked, ["user_email", "id"], "delete")
        stored.upsert(changed, ["user_email", "id"], "upsert")
    return H.newest_per_user(stored.read()).select("user_email", "id", "findings_count", "max_ess")


@query("history_of_scans", O.with_(f"{O.F}, {Q.CORPUS_FILES}, {Q.CHOSEN}, {Q.REPO_F}, SMM as ({O.summary_select('E', ['scan_id'])})",
       """select concat('owner of ', c.repo) as user_email, 'github' as scan_type, c.repo as target, cast(coalesce(f.n, 0) as int) as findings_count, coalesce(max_ess, 0.0) as max_ess, coalesce(label, 'INFO') as ess_label, cast(c.n as int) as sources_scanned
 from (select repo, count(*) as n from CHS group by repo) c left join (select scan_id, count(*) as n from RFF group by scan_id) f on f.scan_id = c.repo left join SMM on SMM.scan_id = c.repo
 where c.repo in ('repo1', 'repo2')"""))
def history_of_scans(spark, sf):
    """History that scans have appended, read back for two of their users; the run is repeated and stays once."""
    folder = _new_folder(spark, "history")
    rows = P.history_rows(P.scan_repo(*Q._repo_tables(spark, sf)).stored(), "github", user=F.concat(F.lit("owner of "), F.col("scan_id")))
    for _ in range(2):
        append_history(rows, folder, "monday")
    stored = spark.read.parquet(folder)
    found = H.user_history(stored, "owner of repo1").unionByName(H.user_history(stored, "owner of repo2"))
    return found.select("user_email", "scan_type", "target", "findings_count", "max_ess", "ess_label", "sources_scanned")


# --- batches that count whole ------------------------------------------------------------------------------------

class _Stopped(RuntimeError):
    pass


class _StoppingSink(A.AlertSink):
    """Ends between the two writes of its batch, as a lost driver would."""

    def write_alert(self, findings, batch_id):
        raise _Stopped("stopped between findings and alert")


_BY_RISK = ", ".join(f"count(*) filter (where risk = '{r}') as {r.lower()}" for r in ("Critical", "High", "Medium"))


@query("alert_runs", O.with_(f"{O.F}, X as (select distinct type, value, risk from F)", f"""select 'findings' as part, count(*) as total, {_BY_RISK} from X
union all select 'alerts', count(*), {_BY_RISK} from X union all select 'after the stop', 0, 0, 0, 0"""))
def alert_runs(spark, sf):
    """An alert stream that was stopped between the two writes of a batch and started again: what readers see after the stop, and
    findings and alerts after the second start."""
    folder = _new_folder(spark, "alert-runs")
    docs = Q.corpus(spark, sf).select(
        F.lit("pastebin").alias("kind"), F.col("container").alias("target"), "path", F.col("source_url").alias("url"), "text",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("landed_at"))
    docs.write.parquet(f"{folder}/landing")
    counts = [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("Critical", "High", "Medium"))]

    def run(sink):
        queries = A.alert_stream(spark, f"{folder}/landing", None, f"{folder}/out", f"{folder}/state", profile="fast", fmt="parquet", once=True,
                                 horizon="365 days", sink=sink)
        queries.awaitTermination()

    try:
        run(_StoppingSink(spark, f"{folder}/out"))
    except Exception as exc:  # the query ends with the sink's error
        if "stopped between" not in str(exc):
            raise
    seen = len(Folder(spark, f"{folder}/out/commits").names())
    run(A.AlertSink(spark, f"{folder}/out"))
    findings, alerts = (A.committed(spark, f"{folder}/out", what) for what in ("findings", "alerts"))
    names = ["total", "critical", "high", "medium"]
    summed = alerts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    stop = spark.range(1).select(*[F.lit(seen).cast("long").alias(c) for c in names])
    parts = [("findings", findings.agg(*counts)), ("alerts", summed), ("after the stop", stop)]
    rows = [df.select(F.lit(part).alias("part"), *names) for part, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- layouts -----------------------------------------------------------------------------------------------------

_LOST = "doc_id % 10 = 4"


@query("bucketed_repo_scan", O.with_(f"{O.F}, {Q.CORPUS_FILES}", f"""select 'finding' as part, repo, path, type, count(*) as n from F join (select repo, path, doc_id from RF) using (doc_id) where not ({_LOST}) group by repo, path, type
 union all select 'error', repo, path, 'Scan failed: no content', 1 from RF where {_LOST}""".replace("select repo, path, doc_id from RF) using", "select repo, path as rp, doc_id from RF) using").replace("repo, path, type, count(*)", "repo, rp as path, type, count(*)").replace("group by repo, path, type", "group by repo, rp, type")))
def bucketed_repo_scan(spark, sf):
    """Listing and contents landed in equal buckets: their join moves no text. Every tenth file's contents haven't landed."""
    files, contents = Q._repo_tables(spark, sf)
    landed = contents.filter(F.regexp_extract("path", "f([0-9]+)", 1).cast("long") % 10 != 4)
    folder, name = _new_folder(spark, "layout"), uuid.uuid4().hex
    listing = land_bucketed(files, f"files_{name}", f"{folder}/files", buckets=8)
    texts = land_bucketed(landed, f"contents_{name}", f"{folder}/contents", buckets=8)
    out = P.scan_repo(listing, texts, colocated=True)
    found = out.findings.groupBy("repo", "path", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("finding"))
    errors = out.errors.select(F.lit("error").alias("part"), F.col("target").alias("repo"), "path", F.col("message").alias("type"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(errors)


@query("lockfile_findings", O.with_(O.F, "select doc_id, type, value, true as screened_out from F"))
def lockfile_findings(spark, sf):
    """What stands in lock files and source maps is found; only `screen` leaves such files out."""
    name = F.when(F.col("doc_id") % 2 == 0, "repo/package-lock.json").otherwise("site/x.map")
    docs = Q.corpus(spark, sf).withColumn("path", name)
    found, screened = (scan(docs, screen=how).select("doc_id", "type", "value") for how in (False, True))
    return found.join(screened.withColumn("_s", F.lit(True)), ["doc_id", "type", "value"], "left").withColumn("screened_out", F.col("_s").isNull()).drop("_s")


# --- scores kept between runs ------------------------------------------------------------------------------------

def _by_length(column):
    """A stand-in for a classifier: texts of odd length look invented."""

    def scorer(frames):
        for frame in frames:
            odd = frame[column].str.len() % 2 == 1
            yield frame[[column]].assign(scores=[{dims.FAKE_LABELS[0]: 0.9 if o else 0.1, "real": 0.1 if o else 0.9} for o in odd])

    return scorer


_LONG = "concat(repeat('text ', 200), doc_id, ' ', type)"


@query("fake_filter_scored", O.with_(O.F, f"""select doc_id, type, cast(round(case when fake then conf * 0.28 else conf end, 3) as double) as confidence, fake as lowered
 from (select *, {O.CANON} in ({', '.join(O.q(t) for t in sorted(dims.FAKE_ELIGIBLE))}) as eligible, length({_LONG}) % 2 = 1 and eligible as fake from F)
 where not eligible or round(case when fake then conf * 0.28 else conf end, 3) >= 0.15"""))
def fake_filter_scored(spark, sf):
    """Snippets of over 512 characters that differ behind that are classified each by itself, in two passes with one table of scores."""
    # both passes read the findings several times: written once, and without the long snippets
    found = checkpointed(corpus_findings(spark, sf, fields=("type", "confidence", "annotation"))).withColumn("snippet", F.concat(F.repeat(F.lit("text "), 200), F.col("doc_id").cast("string"), F.lit(" "), "type"))
    kept = KeptScores(spark, _new_folder(spark, "scores"), 8)
    first = filter_fake(found, _by_length("snippet"), kept=kept)
    second = filter_fake(found.filter(F.col("doc_id") >= 0), _never, kept=kept)
    both = first.select("doc_id", "type", dbl("confidence").alias("confidence")).intersectAll(second.select("doc_id", "type", dbl("confidence").alias("confidence")))
    return both.withColumn("lowered", F.col("confidence") < 0.6)


def _never(frames):
    for frame in frames:
        raise AssertionError(f"{len(frame)} texts are classified again")
    return
    yield


@query("scores_reused", O.with_(D.CONTEXT_CTES, """, N as (select count(*) as n from CF), T as (select count(distinct text) as n from hitsok)
select 1 as pass, T.n as classified, N.n as findings from N, T union all select 2, 0, N.n from N""").replace("\n, N as", ", N as"))
def scores_reused(spark, sf):
    """The context scan twice with one table of scores: the second pass classifies nothing and finds the same."""
    kept, docs, rows, before = KeptScores(spark, _new_folder(spark, "scores"), 8), Q.corpus(spark, sf), [], 0
    for n in (1, 2):
        found = X.scan_in_context(docs, scorer=D._lexical_frames if n == 1 else _never, kept=kept).count()
        stored = kept.table.read().count()
        rows.append((n, stored - before, found))
        before = stored
    return spark.createDataFrame(rows, "pass int, classified long, findings long")


# --- the star of a scan's tables ---------------------------------------------------------------------------------

@query("session_star", f"""with S as (select distinct o_orderkey % 40 as scan_id, case o_orderkey % 40 % 4 when 0 then 'github' when 1 then 'pastes' else 'social' end as scan_type from orders),
L as (select l_orderkey % 40 as scan_id, l_returnflag as platform, count(*) as findings, count(*) filter (where l_linestatus = 'O') as critical from lineitem group by 1, 2),
P as (select o_orderkey % 40 as scan_id, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as platform, count(*) as files from orders group by 1, 2),
E as (select l_orderkey % 40 as scan_id, l_returnflag as platform, max(cast(l_linenumber as double)) as max_ess from lineitem group by 1, 2)
select scan_id, scan_type, platform, files, coalesce(findings, 0) as findings, coalesce(critical, 0) as critical, max_ess from S join P using (scan_id)
 left join L using (scan_id, platform) left join E using (scan_id, platform) where scan_type = 'github'""")
def session_star(spark, sf):
    """The four tables of stored scans, joined for the sessions of one kind: only their partitions of findings and scores are read."""
    folder = _new_folder(spark, "star")
    _stored_star(spark, sf, folder)
    return session_star_of(spark, folder, F.col("scan_type") == "github").select("scan_id", "scan_type", "platform", "files", "findings", "critical", "max_ess")


def _stored_star(spark, sf, folder):
    li, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    k = F.col("l_orderkey") % 40
    findings = li.select(k.alias("scan_id"), F.col("l_returnflag").alias("platform"), F.lit("PAN").alias("type"), F.col("l_partkey").cast("string").alias("value"),
                         F.col("l_comment").alias("snippet") if "l_comment" in li.columns else F.lit("").alias("snippet"),
                         F.when(F.col("l_linestatus") == "O", "Critical").otherwise("Low").alias("risk"))
    ess = li.select(k.alias("scan_id"), F.col("l_returnflag").alias("platform"), F.col("l_linenumber").cast("double").alias("score")).distinct()
    s = F.col("o_orderkey") % 40
    kind = F.when(s % 4 == 0, "github").when(s % 4 == 1, "pastes").otherwise("social")
    sessions = orders.select(s.alias("scan_id"), kind.alias("scan_type")).distinct()
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    platforms = orders.groupBy(s.alias("scan_id"), status.alias("platform")).agg(F.count(F.lit(1)).alias("file_count"))
    write_scan(findings, ess, folder, "2024-05-01", sessions, platforms)


@query("session_totals_ess", """with PL as (select o_orderkey % 50 as session_id, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as platform, count(*) as f from orders group by 1, 2),
L as (select l_orderkey % 50 as session_id, l_returnflag as platform, count(*) as g from lineitem group by 1, 2),
R as (select session_id, platform, cast(sum(f) as bigint) as total_files, cast(sum(g) as bigint) as total_findings from (select session_id, platform, f, 0 as g from PL union all select session_id, platform, 0, g from L) group by rollup (session_id, platform) having session_id is not null),
E as (select l_orderkey % 50 as session_id, max(l_linenumber * 10) as hi, sum(l_linenumber * 10) as s, count(*) as n from lineitem group by 1)
select session_id, platform, total_files, total_findings, cast(hi as double) / 100 as max_ess, cast((2 * s + n) // (2 * n) as double) / 100 as avg_ess from R left join E using (session_id)""")
def session_totals_ess(spark, sf):
    """Files and findings of every session with its highest and mean score."""
    li, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    leaks = li.select((F.col("l_orderkey") % 50).alias("session_id"), F.col("l_returnflag").alias("platform"))
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    platforms = orders.select((F.col("o_orderkey") % 50).alias("session_id"), status.alias("platform"), F.lit(1).alias("file_count"))
    scored = li.select((F.col("l_orderkey") % 50).alias("session_id"), (F.col("l_linenumber").cast("decimal(4,2)") / 10).alias("score"))
    return session_totals(leaks, platforms, scored)


@query("types_of_sources", "select p_partkey, array_to_string(list_sort(list_distinct(list_concat(case when p_partkey % 3 = 0 then [] else [p_brand, p_type] end, case when p_partkey % 2 = 0 then [p_type, p_name] else [] end))), ',') as types from part")
def types_of_sources(spark, sf):
    """The types that two scans of a source found, together; a scan that found none has no list."""
    k = F.col("p_partkey")
    one, two = F.when(k % 3 != 0, F.array("p_brand", "p_type")), F.when(k % 2 == 0, F.array("p_type", "p_name"))
    return table(spark, sf, "part").select("p_partkey", joined(type_union(one, two)).alias("types"))


@query("users_overview", f"""with L as (select concat('u', c_custkey) as user_email, c_mktsegment as notes, c_custkey as v from customer where c_custkey % 3 <> 0),
T as (select user_email, count(*) as total_scans, cast(sum(findings_count) as bigint) as total_findings, max(max_ess) as max_ess, cast(sum(sources_scanned) as bigint) as sources_scanned, arg_max(id, (created_at, id)) as last_id, arg_max(scan_type, (created_at, id)) as last_scan_type from {Q.HIST} group by user_email)
select coalesce(L.user_email, T.user_email) as user_email, notes, coalesce(total_scans, 0) as total_scans, coalesce(total_findings, 0) as total_findings, coalesce(max_ess, 0.0) as max_ess, coalesce(sources_scanned, 0) as sources_scanned, last_id, last_scan_type
 from L full join T on L.user_email = T.user_email""")
def users_overview(spark, sf):
    """Profiles with history; two thirds of the customers have a profile, others only scans or only a profile."""
    k = F.col("c_custkey")
    old = table(spark, sf, "customer").filter(k % 3 != 0).select(F.concat(F.lit("u"), k.cast("string")).alias("user_email"), F.lit("old").alias("notes"), F.lit(1).alias("updated_at"))
    log = old.unionByName(table(spark, sf, "customer").filter(k % 3 != 0).select(F.concat(F.lit("u"), k.cast("string")).alias("user_email"), F.col("c_mktsegment").alias("notes"), F.lit(2).alias("updated_at")))
    return H.users_overview(log, Q._history(spark, sf)).drop("updated_at", "last_scan_at")


# --- sessions with late rows -------------------------------------------------------------------------------------

#: Events land a run for each ten days; of one in seven the user's file comes a run later, of one in 29 two runs later.
GAP_S, DELAY, DELAY_S, RUNS = 1800, "2 days", 172800, 4
_RUN = f"least(cast(floor((epoch(ts) - 1704067200) / 864000) as int) + (case when event_id % 7 = 3 then 1 when event_id % 29 = 5 then 2 else 0 end), {RUNS - 1})"


@query("stream_sessions_late", f"""with E as (select *, cast(epoch_us(ts) as bigint) as us, {_RUN} as run from events where ts >= timestamp '2024-01-01'),
M as (select r.run, (select max(us) from E where E.run < r.run) as newest from (select unnest(range(0, {RUNS + 1})) as run) r),
W as (select run, coalesce(greatest(newest // 1000 - {DELAY_S * 1000}, 0), 0) * 1000 // {GAP_S * 1000000} as first_open from M),
J as (select E.*, us // {GAP_S * 1000000} as slot, us // {GAP_S * 1000000} < first_open as late from E join W using (run)),
S as (select user_id, min(us) as lo, max(us) as hi, count(*) as n from (select *, sum(fresh) over (partition by user_id order by us, event_id) as k from (
 select *, case when us - lag(us) over (partition by user_id order by us, event_id) <= {GAP_S * 1000000} then 0 else 1 end as fresh from J where not late)) group by user_id, k)
select 'session' as part, user_id, make_timestamp(lo) as session_start, make_timestamp(hi) as last_event, n as events from S
 where (hi + {GAP_S * 1000000}) // {GAP_S * 1000000} + 1 <= (select first_open from W where run = {RUNS})
union all select 'late', user_id, make_timestamp(min(us)), make_timestamp(max(us)), count(*) from J where late group by user_id, run, slot""")
def stream_sessions_late(spark, sf):
    """Sessions of a stream whose files come out of order, in runs on one checkpoint, and the rows that came too late for theirs."""
    events = table(spark, sf, "events")
    at, kind = F.col("ts").cast("timestamp"), events.schema["ts"].dataType
    run = F.floor((F.unix_micros(at) / 1e6 - 1704067200) / 864000) + F.when(F.col("event_id") % 7 == 3, 1).when(F.col("event_id") % 29 == 5, 2).otherwise(0)
    first = F.lit("2024-01-01").cast(kind)
    dealt = events.filter(F.col("ts") >= first).select("user_id", at.alias("ts"), F.least(run, F.lit(RUNS - 1)).cast("int").alias("run"))
    folder, session = _new_folder(spark, "sessions"), M.state_session(spark)
    for n in range(RUNS):
        dealt.filter(F.col("run") == n).drop("run").write.mode("append").parquet(f"{folder}/landing")
        landed = session.readStream.schema(dealt.drop("run").schema).parquet(f"{folder}/landing")
        found = N.sessions_with_late(landed, ["user_id"], "ts", GAP_S, DELAY)
        q = (found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/sessions")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/sessions")
    return rows.select("part", "user_id", F.col("session_start").cast(kind).alias("session_start"), F.col("last_event").cast(kind).alias("last_event"), "events")


# --- landed bodies -----------------------------------------------------------------------------------------------

#: Landed bodies of ten kinds, as both engines write them: whole, cut off, broken, mistyped, without list, without key, empty, none.
_PASTE = """concat('[{{"key":"k', event_id, '","title":"', event_type, '","size":', user_id, '}},{{"key":"m', event_id, '","size":"7"}}{}')"""
BODY = f"""case event_id % 10 when 0 then {_PASTE.format(']')} when 1 then {_PASTE.format('')} when 2 then concat('{{', event_type, ' ', event_id)
 when 3 then concat('[{{"key":"t', event_id, '","size":"many"}},{{"key":"u', event_id, '","size":', user_id, '}}]') when 4 then concat('{{"items":[', user_id, ']}}')
 when 5 then concat('[{{"title":"', event_type, '"}},null,{{"key":"v', event_id, '","syntax":"x"}}]') when 6 then '[]' when 7 then cast(null as {{0}})
 when 8 then concat('[{{"key":{{"a":', user_id, '}}}}]') else concat('  ', props) end"""


@query("landed_errors", f"""with B as (select event_id, {BODY.replace('{0}', 'varchar')} as body from events),
P as (select *, case when body is null or trim(body) = '' then 'no content' when not json_valid(body) then 'unreadable record' when json_type(body) <> 'ARRAY' then 'no list at $' end as bad from B),
I as (select event_id, unnest(range(0, cast(json_array_length(body) as bigint))) as position, body from P where bad is null),
V as (select event_id, position, json_extract(body, concat('$[', position, ']')) as item from I),
X as (select *, json_extract_string(item, '$.key') as key, json_type(item, '$.key') as key_type, json_extract_string(item, '$.size') as size from V),
R as (select *, case when key is null then 'no key' when key_type in ('OBJECT', 'ARRAY') then 'key is no string' when size is not null and try_cast(size as int) is null then 'size is no int' end as bad from X)
select 'item' as part, event_id, cast(position as int) as position, key as what, try_cast(size as int) as size from R where bad is null
union all select 'error', event_id, cast(position as int), concat('Scan failed: ', bad), null from R where bad is not null
union all select 'error', event_id, null, concat('Scan failed: ', bad), null from P where bad is not null""")
def landed_errors(spark, sf):
    """Landed paste listings, whole and not: what is an item, and an error row for everything else."""
    raw = table(spark, sf, "events").select("event_id", F.expr(BODY.replace("{0}", "string")).alias("body"))
    out = J.landed_items(raw, J.PASTES)
    items = out.items.select(F.lit("item").alias("part"), "event_id", "position", F.col("key").alias("what"), "size")
    return items.unionByName(out.errors.select(F.lit("error").alias("part"), "event_id", "position", F.col("message").alias("what"), F.lit(None).cast("int").alias("size")))
