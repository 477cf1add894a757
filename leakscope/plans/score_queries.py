"""Queries: exposure scores, rollups, distributions, links, playbooks, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from leakscope import dims
from leakscope.operators import ess as E
from leakscope.operators import links as K
from leakscope.operators import playbook as P
from leakscope.operators import report as RP
from leakscope.operators import rollups as R
from leakscope.operators.detect import scan
from leakscope.operators.numbering import checkpointed, number_rows
from leakscope.plans import oracle_sql as O
from leakscope.plans.detection_queries import DOC_LIST
from leakscope.plans.registry import corpus, corpus_findings, dbl, joined, query, table

FILE = ["container", "path", "platform"]


def _ess(spark, sf, keys, vocab="canonical"):
    return E.ess(corpus_findings(spark, sf, fields=("type", "confidence")).withColumn("source_type", F.col("platform")), keys, "source_type", vocab)


def _flat(scored, keys):
    return scored.select(*keys, "score", "base_score", "toxic_combo_label", "toxic_multiplier", "exposure_multiplier",
                         "confidence_penalty", joined("types_found").alias("types_found"), "ess_label", "findings_count")


def _ess_query(name, keys, vocab="canonical"):
    sql = O.with_(f"{O.F},\n{O.ess_ctes('F', keys, 'platform', canonical=vocab == 'canonical')}", f"select {', '.join(keys)}, {O.ESS_COLUMNS} from E")
    query(name, sql)(lambda spark, sf: _flat(_ess(spark, sf, keys, vocab), keys))


_ess_query("ess_by_file", FILE)
_ess_query("ess_by_repo", ["container", "platform"])
_ess_query("ess_by_platform", ["platform"])
_ess_query("ess_by_file_as_is", FILE, "as_is")


@query("ess_breakdown", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}", """select container, path, platform, cast(base as double) as b_base, cast(round(toxic, 3) as double) as b_toxic,
 cast(round(wide, 3) as double) as b_exposure, cast(penalty as double) as b_penalty, cast(score as double) as b_final from E"""))
def ess_breakdown(spark, sf):
    b = lambda f, a: F.col(f"breakdown.{f}").alias(a)
    return _ess(spark, sf, FILE).select(*FILE, b("base_score", "b_base"), b("after_toxic_combo", "b_toxic"), b("after_exposure", "b_exposure"),
                                        b("confidence_penalty", "b_penalty"), b("final_score", "b_final"))


@query("ess_of_all", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}", """select d.container, d.path, d.platform, cast(coalesce(score, 0) as double) as score, coalesce(combo, 'none') as toxic_combo_label,
 coalesce(array_to_string(types, ','), '') as types_found, coalesce(n, 0) as findings_count from (select distinct container, path, platform from D) d left join E using (container, path, platform)"""))
def ess_of_all(spark, sf):
    out = E.ess_of_all(corpus(spark, sf), _ess(spark, sf, FILE), FILE)
    return out.select(*FILE, "score", "toxic_combo_label", joined("types_found").alias("types_found"), F.col("findings_count").cast("bigint").alias("findings_count"))


@query("scan_summary", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}", O.summary_select("E", ["platform"])))
def scan_summary(spark, sf):
    out = E.scan_summary(_ess(spark, sf, FILE), "platform")
    return out.withColumn("all_types", joined("all_types"))


@query("toxic_combos", O.with_(f"{O.F},\n{O.ess_ctes('F', ['container', 'platform'], 'platform')}",
       "select platform, combo as toxic_combo_label, cast(max(mult) as double) as toxic_multiplier, count(*) as sources from E where combo <> 'none' group by platform, combo"))
def toxic_combos(spark, sf):
    return R.scan_combos(_ess(spark, sf, ["container", "platform"]), "platform")


DOC_ESS = f"{DOC_LIST}, DT as (select *, 'unknown' as st from DF), {O.ess_ctes('DT', ['source'], 'st')}"


@query("document_exposure", O.with_(DOC_ESS, f"select source, {O.ESS_COLUMNS} from E"))
def document_exposure(spark, sf):
    """Flagship: whole documents -> findings -> exposure score per source."""
    found = scan(table(spark, sf, "documents"), filename=None, fields=("type", "confidence")).withColumn("source_type", F.lit("unknown"))
    return _flat(E.ess(found, "source", "source_type"), ["source"])


@query("document_summary", O.with_(DOC_ESS, O.summary_select("E", [])))
def document_summary(spark, sf):
    found = scan(table(spark, sf, "documents"), filename=None, fields=("type", "confidence")).withColumns({"source_type": F.lit("unknown"), "scan_id": F.lit(1)})
    out = E.scan_summary(E.ess(found, ["scan_id", "source"], "source_type"), "scan_id").drop("scan_id")
    return out.withColumn("all_types", joined("all_types"))


@query("sources_scanned", "select source, count(distinct lang) as total_sources_scanned from documents group by source")
def sources_scanned(spark, sf):
    return E.sources_scanned(table(spark, sf, "documents"), "lang", "source")


# --- distributions -----------------------------------------------------------------------------------------------

LEVELS = "(values (0, 'Critical'), (1, 'High'), (2, 'Medium'), (3, 'Low')) lv(risk_rank, risk)"


@query("risk_distribution", O.with_(O.F, f"""select p.platform, lv.risk_rank, lv.risk, count(F.risk) as findings, cast((count(F.risk) * 10000 * 2 + any_value(t.n)) // (2 * any_value(t.n)) as double) / 100 as pct
 from (select distinct platform from F) p cross join {LEVELS} join (select platform, count(*) as n from F group by platform) t on t.platform = p.platform
 left join F on F.platform = p.platform and F.risk = lv.risk group by p.platform, lv.risk_rank, lv.risk"""))
def risk_distribution(spark, sf):
    return R.risk_distribution(corpus_findings(spark, sf, fields=("risk",)), "platform")


AVG3 = "cast((cast(sum(cast(conf * 1000 as bigint)) as bigint) * 2 + count(*)) // (2 * count(*)) as double) / 1000"


@query("type_distribution", O.with_(O.F, f"""select platform, type, count(*) as findings, {AVG3} as avg_confidence, cast(min(conf) as double) as min_confidence, cast(max(conf) as double) as max_confidence,
 cast(row_number() over (partition by platform order by count(*) desc, type) as int) as type_rank from (select * replace ({O.CANON} as type) from F) group by platform, type"""))
def type_distribution(spark, sf):
    return R.type_distribution(corpus_findings(spark, sf), "platform", "canonical")


@query("top_type", O.with_(O.F, "select platform, type, findings from (select platform, type, count(*) as findings, row_number() over (partition by platform order by count(*) desc, type) as rn from F group by platform, type) where rn = 1"))
def top_type(spark, sf):
    return R.top_type(corpus_findings(spark, sf), "platform")


@query("confidence_bands", O.with_(O.F, f"""select platform, count(*) as findings, count(*) filter (where conf >= 0.8) as high, count(*) filter (where conf >= 0.5 and conf < 0.8) as medium,
 count(*) filter (where conf < 0.5) as low, {AVG3} as avg_confidence, cast(0 as bigint) as validated, count(*) as annotated from F group by platform"""))
def confidence_bands(spark, sf):
    return R.confidence_bands(corpus_findings(spark, sf), "platform")


@query("alert_summary", O.with_(O.F, "select container, count(*) as total, count(*) filter (where risk = 'Critical') as critical, count(*) filter (where risk = 'High') as high, count(*) filter (where risk = 'Medium') as medium from F group by container"))
def alert_summary(spark, sf):
    return R.alert_summary(corpus_findings(spark, sf, fields=("risk",)), "container")


@query("alert_sample", O.with_(O.F, "select type, value_masked, risk, doc_id from F order by case risk when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 else 3 end, conf desc, type, value, doc_id limit 10"))
def alert_sample(spark, sf):
    return R.alert_sample(corpus_findings(spark, sf), 10, "risk", "doc_id").select("type", "value_masked", "risk", "doc_id")


@query("first_per_value", "select event_type as type, user_id as value, min(event_id) as first_event, arg_min(props, (ts, event_id)) as props from events group by event_type, user_id")
def first_per_value(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("value"), "ts", "event_id", "props")
    return R.first_per_value(ev, ["ts", "event_id"]).select("type", "value", F.col("event_id").alias("first_event"), "props")


@query("combined_scan", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}, A as (select * from ({O.summary_select('E', ['platform'])}) where platform = 'github_public'), B as (select * from ({O.summary_select('E', ['platform'])}) where platform = 'pastebin')",
       """select greatest(a.max_ess, b.max_ess) as max_ess, (cast(a.avg_ess * 100 as bigint) + cast(b.avg_ess * 100 as bigint)) / 200.0 as avg_ess, case when a.max_ess >= b.max_ess then a.label else b.label end as label,
 case when a.max_ess >= b.max_ess then a.color else b.color end as color, a.total_sources + b.total_sources as total_sources,
 array_to_string(list_sort(list_distinct(list_concat(string_split(a.all_types, ','), string_split(b.all_types, ',')))), ',') as all_types from A a, B b"""))
def combined_scan(spark, sf):
    both = E.scan_summary(_ess(spark, sf, FILE), "platform").withColumn("scan_id", F.lit("combined"))
    a, b = (both.filter(F.col("platform") == p).drop("platform") for p in ("github_public", "pastebin"))
    return R.combine_scans(a, b).drop("scan_id").withColumn("all_types", joined("all_types"))


@query("union_findings", O.with_(O.F, "select platform, type, count(*) as findings, count(*) filter (where platform = 'telegram') as with_channel from F where platform in ('github_public', 'telegram') group by platform, type"))
def union_findings(spark, sf):
    docs = corpus(spark, sf)
    a = scan(docs.filter(F.col("platform") == "github_public"))
    b = scan(docs.filter(F.col("platform") == "telegram").withColumn("channel", F.col("container")))
    return R.union_findings(a, b).groupBy("platform", "type").agg(F.count(F.lit(1)).alias("findings"), F.count("channel").alias("with_channel"))


@query("findings_by_confidence", O.with_(O.F, "select doc_id, type, cast(conf as double) as confidence from F where platform = 'telegram'"))
def findings_by_confidence(spark, sf):
    found = corpus_findings(spark, sf).filter(F.col("platform") == "telegram")
    return R.by_confidence(found).select("doc_id", "type", dbl("confidence").alias("confidence"))


@query("numbered_findings", O.with_(O.F, "select platform, doc_id, type, cast(row_number() over (partition by platform order by doc_id, s, type) as bigint) as row_no from F"))
def numbered_findings(spark, sf):
    """Dense numbers per scan over a range partitioning, for a list of any length."""
    return number_rows(corpus_findings(spark, sf), "platform", ["doc_id", "start", "type"]).select("platform", "doc_id", "type", F.col("row_no").cast("bigint").alias("row_no"))


# --- links -------------------------------------------------------------------------------------------------------

PARTNERS = "select c_custkey from customer where c_custkey % 3 = 0"
LINK_SRC = """LK as (select type, platform, case when type = 'PHONE' and length(n) = 12 and n like '91%' then substr(n, 3) else n end as n from (
 select type, platform, lower(case when type = 'PHONE' then regexp_replace(value, '[^0-9]', '', 'g') else regexp_replace(value, '[\\s\\-]', '', 'g') end) as n from F
 union all select 'PHONE', 'crm', cast(6000000000 + (c_custkey * 7919) % 4000000000 as varchar) from customer
 union all select 'EMAIL', 'crm', lower(concat('USER', c_custkey, '@MAIL', c_custkey % 5, '.example.com')) from customer))"""


@query("identity_links", O.with_(f"{O.F}, {LINK_SRC}", f"""select {O.CANON} as type, sha256(concat({O.CANON}, '|', n)) as cluster_id, count(distinct platform) as platforms, count(*) as findings,
 min(platform) as first_platform, max(platform) as last_platform from LK group by type, n having count(distinct platform) > 1"""))
def identity_links(spark, sf):
    key = F.col("c_custkey")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    crm = table(spark, sf, "customer")
    phones = crm.select(F.lit("PHONE").alias("type"), text("+91 ", F.lit(6000000000) + (key * 7919) % F.lit(4000000000)).alias("value"), F.lit("crm").alias("platform"))
    mails = crm.select(F.lit("EMAIL").alias("type"), text("USER", key, "@MAIL", key % 5, ".example.com").alias("value"), F.lit("crm").alias("platform"))
    found = corpus_findings(spark, sf, fields=("type", "value")).select("type", "value", "platform")
    return K.identity_links(R.union_findings(found, phones, mails))


# --- playbooks, advice -------------------------------------------------------------------------------------------


@query("exposed_by_repo", O.with_(O.F, f"select container as repo, count(distinct path) as leaked_files, min(path) as first_file, array_to_string(list_sort(list(distinct {O.CANON})), ',') as entity_types from F group by container"))
def exposed_by_repo(spark, sf):
    return P.exposed_by_repo(corpus_findings(spark, sf, fields=("type",))).withColumn("entity_types", joined("entity_types"))


@query("exposed_files", O.with_(O.F, "select distinct container as repo, path from F"))
def exposed_files(spark, sf):
    return P.exposed_files(corpus_findings(spark, sf))


@query("playbook_by_repo", O.with_(O.F, """select container as repo, count(distinct path) as leaked_files, cast(7 as int) as steps, case when count(distinct path) > 1 then 6 else 1 end as purge_lines,
 concat('gh repo edit ', container, ' --visibility private') as first_command, true as purge_destructive from F group by container"""))
def playbook_by_repo(spark, sf):
    books = P.playbooks(P.exposed_by_repo(corpus_findings(spark, sf)))
    step = lambda i: F.get("steps", F.lit(i))
    return books.select("repo", "leaked_files", F.size("steps").alias("steps"), F.size(step(3)["commands"]).alias("purge_lines"),
                        F.get(step(0)["commands"], F.lit(0)).alias("first_command"), step(3)["is_destructive"].alias("purge_destructive"))


@query("playbook_lines", O.with_(O.F, "select distinct container as repo, path, 4 as section, 7 as line, path as text from F where container in (select container from F group by container having count(distinct path) > 1)"))
def playbook_lines(spark, sf):
    """The file list inside each playbook: one line per exposed file at its place."""
    found = corpus_findings(spark, sf)
    lines = P.playbook_markdown(P.playbooks(P.exposed_by_repo(found)), P.exposed_files(found))
    return lines.filter(F.col("path") != "")


@query("playbook_documents", O.with_(O.F, "select container as repo, count(distinct path) as path_lines, concat('**Exposed files:** ', count(distinct path)) as files_line, 7 as warnings_and_steps from F group by container"))
def playbook_documents(spark, sf):
    found = corpus_findings(spark, sf)
    lines = P.playbook_markdown(P.playbooks(P.exposed_by_repo(found)), P.exposed_files(found))
    return lines.groupBy("repo").agg(
        F.count_if(F.col("path") != "").alias("path_lines"), F.max(F.when(F.col("text").startswith("**Exposed"), F.col("text"))).alias("files_line"),
        F.count_if(F.col("text").startswith("## ") & (F.col("text") != "## Afterwards")).cast("int").alias("warnings_and_steps"))


ADVISED = "case " + " ".join(f"when t in ({', '.join(O.q(x) for x in types)}) then {O.q(text)}" for types, text in P.ADVICE) + " end"


@query("advice_by_type", O.with_(O.F, f"select platform, t as types, coalesce(advice, {O.q(P.GENERAL_ADVICE)}) as advice from (select distinct platform, t, {ADVISED} as advice from (select platform, {O.CANON} as t from F))"))
def advice_by_type(spark, sf):
    from leakscope.functions.scoring import canonical_type

    kinds = corpus_findings(spark, sf).select("platform", canonical_type(F.col("type")).alias("types")).distinct()
    return kinds.select("platform", "types", F.explode(P.advice_for(F.array("types"))).alias("advice"))


# --- report ------------------------------------------------------------------------------------------------------


def _report_input(spark, sf):
    shown = ("type", "value_masked", "masked_snippet", "confidence", "risk", "annotation", "start")  # reports show neither value nor snippet
    found = corpus_findings(spark, sf, masked=True, fields=shown).withColumns({"scan_id": F.col("platform"), "source": F.concat("container", F.lit("/"), "path"), "source_type": F.col("platform")})
    found = checkpointed(found)  # many sections read the findings; the texts are scanned once
    scored = E.ess(found, ["scan_id", "container", "path"], "source_type")
    scans = corpus(spark, sf).groupBy(F.col("platform").alias("scan_id")).agg(F.count(F.lit(1)).alias("files_scanned")).withColumns({
        "target": F.concat(F.lit("org <"), F.col("scan_id"), F.lit(">")), "scan_duration": F.lit(1.5),
        "scan_type": F.when(F.col("scan_id") == "github_public", "github").when(F.col("scan_id") == "pastebin", "pastebin").otherwise("other")})
    return found, scored, E.scan_summary(scored, "scan_id"), scans


@query("report_risk", O.with_(O.F, f"""select p.platform as scan_id, lv.risk_rank, lv.risk, count(F.risk) as findings, cast((count(F.risk) * 10000 * 2 + any_value(t.n)) // (2 * any_value(t.n)) as double) / 100 as pct
 from (select distinct platform from F) p cross join {LEVELS} join (select platform, count(*) as n from F group by platform) t on t.platform = p.platform
 left join F on F.platform = p.platform and F.risk = lv.risk group by p.platform, lv.risk_rank, lv.risk"""))
def report_risk(spark, sf):
    return RP.report_tables(*_report_input(spark, sf))["risk"]


TOP = "select platform, type as top_type, n as top_n from (select platform, type, n, row_number() over (partition by platform order by n desc, type) as rn from (select platform, type, count(*) as n from (select * replace (" + O.CANON + " as type) from F) group by platform, type)) where rn = 1"
NAME = O.sql_map(dims.DISPLAY_NAMES, "top_type", "top_type")
WHERE = "case platform when 'github_public' then 'GitHub' when 'pastebin' then 'Pastebin' else 'other sources' end"


@query("executive_summary", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}, SM as ({O.summary_select('E', ['platform'])}), TP as ({TOP}), "
       "RC as (select platform, count(*) as n, count(*) filter (where risk = 'Critical') as crit, count(*) filter (where risk = 'High') as high from F group by platform)",
       f"""select platform as scan_id, concat('<strong>org &lt;', platform, '&gt;</strong> (', {WHERE}, '): <strong>', n, ' finding', case when n = 1 then '' else 's' end, '</strong>, ', crit + high,
 ' of them critical or high. Most common: ', {NAME}, ', ', top_n, 'x. Worst exposure <strong>', printf('%.1f', max_ess), ' of 10, ', label, '</strong>. ',
 case when max_ess >= 7 then 'Act today: revoke, remove and notify.' when max_ess >= 4 then 'Plan a clean-up this week.' else 'Keep an eye on it.' end) as summary
 from RC join TP using (platform) join SM using (platform)"""))
def executive_summary(spark, sf):
    return RP.report_tables(*_report_input(spark, sf))["overview"].select("scan_id", F.col("executive_summary").alias("summary"))


@query("report_gauge", O.with_(f"{O.F},\n{O.ess_ctes('F', FILE, 'platform')}, SM as ({O.summary_select('E', ['platform'])})",
       "select platform as scan_id, max_ess, avg_ess, total_sources as sources, label, color, case when max_ess >= 8 then 'Critical' when max_ess >= 6 then 'High' when max_ess >= 4 then 'Medium' else 'Low' end as band_ui from SM"))
def report_gauge(spark, sf):
    return RP.report_tables(*_report_input(spark, sf))["gauge"]


@query("report_types", O.with_(O.F, f"""select platform as scan_id, t as type, {O.sql_map(dims.DISPLAY_NAMES, 't', 't')} as display_name, count(*) as findings, {O.sql_map(RP.IMPACT, 't', "''")} as impact from (select *, {O.CANON} as t from F) group by platform, t"""))
def report_types(spark, sf):
    return RP.report_tables(*_report_input(spark, sf))["types"].select("scan_id", "type", "display_name", "findings", "impact")


@query("report_remediation", O.with_(O.F, f"select * from (select distinct platform as scan_id, t as type, {O.sql_map(dims.DISPLAY_NAMES, 't', 't')} as display_name, {O.sql_map(RP.REMEDY, 't', 'null')} as advice from (select *, {O.CANON} as t from F)) where advice is not null"))
def report_remediation(spark, sf):
    return RP.report_tables(*_report_input(spark, sf))["remediation"]


ROW = ("concat('<tr><td>', row_number() over (partition by platform order by source, doc_id, s, t), '</td><td>', " + O.sql_map(dims.DISPLAY_NAMES, "t", "t") + ", '</td><td>', value_masked, "
       "'</td><td><span style=\"color:#ffc107\">', case when conf = 0.75 then '75' else '65' end, '%</span></td><td><span style=\"color:', " + O.sql_map(dims.RISK_COLORS, "risk", "'#aaaaaa'")
       + ", '\">', risk, '</span></td><td><a href=\"', source_url, '\">', source, '</a></td><td>', snippet, '</td><td>fast regex match</td></tr>')")


@query("report_findings", O.with_(f"{O.F},\n{O.MASKED}", f"select platform as scan_id, {ROW} as html from (select *, {O.CANON} as t, concat(container, '/', path) as source from FM)"))
def report_findings(spark, sf):
    """The findings section of the report, one fragment per finding."""
    found, scored, summary, scans = _report_input(spark, sf)
    out = RP.report_fragments(found, scored, summary, scans)
    return out.filter((F.col("section") == 5) & (F.col("row_no") > 0)).select("scan_id", "html")


@query("report_sections", O.with_(O.F, "select platform as scan_id, count(*) as finding_rows, 11 as sections from F group by platform"))
def report_sections(spark, sf):
    """Size of every report: finding rows and distinct sections (0 to 10, the toxic section only where it applies)."""
    found, scored, summary, scans = _report_input(spark, sf)
    out = RP.report_fragments(found, scored, summary, scans)
    return out.groupBy("scan_id").agg(F.count_if((F.col("section") == 5) & (F.col("row_no") > 0)).alias("finding_rows"),
                                      F.count_distinct("section").cast("int").alias("sections"))
