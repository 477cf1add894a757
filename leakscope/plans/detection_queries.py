"""Queries: screening, detection, validation, context, redaction."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions import scoring as S
from leakscope.functions import validators as V
from leakscope.functions.text import normalise_handle
from leakscope.operators import context as X
from leakscope.operators import detect as D
from leakscope.operators.fakefilter import filter_fake
from leakscope.operators.kyc import classify_document, document_type, is_kyc, kyc_findings
from leakscope.operators.numbering import checkpointed, shared_folder
from leakscope.operators.redact import redact_documents
from leakscope.operators.screen import chunk_documents, drop_blank, screened, with_skip_reason
from leakscope.plans import oracle_sql as O
from leakscope.plans.registry import corpus, corpus_findings, dbl, identity, joined, query, table
from leakscope.sources.layout import land_bucketed

# --- whole documents ---------------------------------------------------------------------------------------------

# texts that can match at all: every rule needs one of these
DOC_GATE = r"[0-9]{7}|@|[A-Z]{5}[0-9]|[A-Z]{4}0|[0-9]{4}[\s\-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]"


def _doc_ctes(table_name: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "source, ") -> str:
    source = f"G as (select {key}, {extra}{text} as text from {table_name} where regexp_matches({text}, {O.q(DOC_GATE)}))"
    return f"{source},\n{O.findings_ctes('G', key)},\nDF as (select F0.*, {extra}text from F0 join G using ({key}))"


DOC_LIST = _doc_ctes()


def _doc_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "type", "value_masked", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), dbl("confidence").alias("confidence"))


DOC_SELECT = f"select doc_id, type, {O.MASK} as value_masked, cast(s as int) as start_pos, cast(e as int) as end_pos, cast(conf as double) as confidence from DF"


@query("doc_cards", O.with_(DOC_LIST, DOC_SELECT + " where type = 'CREDIT_CARD'"))
def doc_cards(spark, sf):
    return _doc_out(D.detect(table(spark, sf, "documents"), "CREDIT_CARD", filename=None))


@query("doc_emails", O.with_(DOC_LIST, DOC_SELECT + " where type = 'EMAIL'"))
def doc_emails(spark, sf):
    return _doc_out(D.detect(table(spark, sf, "documents"), "EMAIL", filename=None))


@query("doc_findings", O.with_(DOC_LIST, DOC_SELECT))
def doc_findings(spark, sf):
    return _doc_out(D.scan(table(spark, sf, "documents"), filename=None))


@query("page_findings", O.with_(_doc_ctes("pages", "page_id", "html", ""),
       f"select page_id, type, {O.MASK} as value_masked, cast(s as int) as start_pos, cast(conf as double) as confidence from DF"))
def page_findings(spark, sf):
    found = D.scan(table(spark, sf, "pages"), text="html", filename=None)
    return found.select("page_id", "type", "value_masked", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"))


@query("benchmark_clean", "select item_id from benchmark where regexp_matches(text, '[0-9]{10}|@')")
def benchmark_clean(spark, sf):
    return D.scan(table(spark, sf, "benchmark"), filename=None).select("item_id").distinct()


@query("doc_findings_by_source", O.with_(
    DOC_LIST, "select source, type, count(*) as findings, count(distinct doc_id) as documents from DF group by source, type"))
def doc_findings_by_source(spark, sf):
    found = D.scan(table(spark, sf, "documents"), filename=None)
    per_doc = found.groupBy("source", "type", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("source", "type").agg(F.sum("_n").alias("findings"), F.count(F.lit(1)).alias("documents"))


# --- screening ---------------------------------------------------------------------------------------------------

FOREIGN = r"length(regexp_replace(substr(text, 1, 500), '[\x00-\x7F]', '', 'g'))"
BINARY = f"(length(substr(text, 1, 500)) > 50 and {FOREIGN} * 10 > length(substr(text, 1, 500)) * 3)"
NAMED = "(select doc_id, source, text, concat(source, case doc_id % 7 when 0 then '/package-lock.json' when 1 then '/lib.min.js' when 2 then '/__pycache__/a.pyc' when 3 then '/MAIN.MAP' else '/a.txt' end) as path from documents)"


def _named(spark, sf) -> DataFrame:
    tail = (
        F.when(F.col("doc_id") % 7 == 0, "/package-lock.json").when(F.col("doc_id") % 7 == 1, "/lib.min.js")
        .when(F.col("doc_id") % 7 == 2, "/__pycache__/a.pyc").when(F.col("doc_id") % 7 == 3, "/MAIN.MAP").otherwise("/a.txt")
    )
    return table(spark, sf, "documents").select("doc_id", "source", "text", F.concat("source", tail).alias("path"))


NOISE = O.has("path", dims.SKIP_FILENAME)


@query("screened_documents", f"select doc_id, path from {NAMED} where trim(text) <> '' and not {NOISE} and not {BINARY}")
def screened_documents(spark, sf):
    return screened(_named(spark, sf)).select("doc_id", "path")


@query("skip_reasons", f"""select doc_id, case when {NOISE} then concat('skipped: lock/minified file (', path, ')')
 when {BINARY} then 'skipped: likely binary' when length(split_part(text, chr(10), 1)) > 2000 then 'skipped: minified single-line' end as skip_reason from {NAMED}""")
def skip_reasons(spark, sf):
    return with_skip_reason(_named(spark, sf), profile="strict").select("doc_id", "skip_reason")


@query("blank_filter", "select doc_id, turn_len from (select conv_id as doc_id, case when turn % 3 = 0 then chr(9) || ' ' when turn % 3 = 1 then null else text end as t, cast(length(text) as int) as turn_len from conversations) where regexp_matches(t, '[^\\s]')")
def blank_filter(spark, sf):
    t = F.when(F.col("turn") % 3 == 0, "\t ").when(F.col("turn") % 3 == 1, None).otherwise(F.col("text"))
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("text"), F.length("text").alias("turn_len"))
    return drop_blank(conv).select("doc_id", "turn_len")


@query("chunked_documents", """select doc_id, cast(c as int) as chunk_no, cast(c * 1000 as int) as chunk_start, length(substr(text, c * 1000 + 1, 1000)) as chars, md5(substr(text, c * 1000 + 1, 1000)) as digest
 from (select doc_id, text, unnest(range(0, greatest((length(text) + 999) // 1000, 1))) as c from documents)""")
def chunked_documents(spark, sf):
    parts = chunk_documents(table(spark, sf, "documents").select("doc_id", "text"), 1000)
    return parts.select("doc_id", "chunk_no", "chunk_start", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("chunked_scan", O.with_(DOC_LIST, DOC_SELECT))
def chunked_scan(spark, sf):
    """Slices of 5,000 characters with 200 shared: the same findings as the scan of whole texts."""
    return _doc_out(D.scan(table(spark, sf, "documents"), filename=None, chunk_size=5000, overlap=200))


# --- detectors on the corpora ------------------------------------------------------------------------------------

ONE_TYPE = "select doc_id, value, cast(s as int) as start_pos, cast(e as int) as end_pos, cast(conf as double) as confidence from (select doc_id, v as value, s, e, conf from F0)"


def _one(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), dbl("confidence").alias("confidence"))


def _corpus_type(type_name: str):
    def run(spark, sf):
        return _one(D.detect(corpus(spark, sf), type_name))

    return run


for _short, _type in (("aadhaar", "AADHAAR"), ("pan", "PAN"), ("ssn", "SSN"), ("card", "CREDIT_CARD"), ("email", "EMAIL"), ("phone", "PHONE")):
    query(f"corpus_findings_{_short}", O.with_(",\n".join([O.C, O.D, O.findings_ctes("D", types=[_type])]), ONE_TYPE))(_corpus_type(_type))


def _identity_type(type_name: str):
    def run(spark, sf):
        docs = identity(spark, sf).select(F.col("k").alias("doc_id"), "text")
        return _one(D.detect(docs, type_name, filename=None))

    return run


I_DOCS = f"{O.I}, ID as (select k as doc_id, text from I)"
for _short, _type in (("passport", "PASSPORT_IN"), ("voter", "VOTER_ID"), ("licence", "DL_IN"), ("ifsc", "IFSC"), ("gstin", "GSTIN"), ("upi", "UPI"), ("abha", "ABHA")):
    _checks = O.FULL_CHECK if _type in ("GSTIN", "UPI", "ABHA") else O.LIVE_CHECK
    query(f"identity_findings_{_short}", O.with_(f"{I_DOCS}, {O.findings_ctes('ID', types=[_type], checks=_checks)}", ONE_TYPE))(_identity_type(_type))


@query("raw_hits", O.with_(",\n".join([O.C, O.D, O.raw_ctes("D")]), "select doc_id, type, v as value, cast(s as int) as start_pos, cast(e as int) as end_pos from hits"))
def raw_hits(spark, sf):
    return D.extract_spans(corpus(spark, sf)).select("doc_id", "type", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("corpus_overlap", O.with_(O.F, "select doc_id, type, cast(s as int) as start_pos, cast(e as int) as end_pos, cast(conf as double) as confidence from F"))
def corpus_overlap(spark, sf):
    return corpus_findings(spark, sf).select("doc_id", "type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), dbl("confidence").alias("confidence"))


@query("extended_findings", O.with_(f"{I_DOCS}, {O.findings_ctes('ID', types=O.EXTENDED_TYPES, checks=O.FULL_CHECK)}",
       "select doc_id, type, v as value, cast(s as int) as start_pos, cast(conf as double) as confidence from F0"))
def extended_findings(spark, sf):
    docs = identity(spark, sf).select(F.col("k").alias("doc_id"), "text")
    return D.scan(docs, "extended", filename=None).select("doc_id", "type", "value", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"))


@query("findings", O.with_(O.F, "select doc_id, type, value, value_masked, snippet, cast(conf as double) as confidence, risk, 'fast regex match' as annotation, path, source_url from F"))
def findings(spark, sf):
    """The full finding projection of the live fast scan."""
    return corpus_findings(spark, sf).select("doc_id", "type", "value", "value_masked", "snippet", dbl("confidence").alias("confidence"), "risk", "annotation", "path", "source_url")


ORDER_ID = f"{O.C}, OD as (select k as doc_id, text from C), {O.raw_ctes('OD', types=['AADHAAR'])}, OH as (select doc_id, unnest(regexp_extract_all(text, 'order ([0-9]+) shipped', 1)) as v from OD)"


@query("registered_pattern", O.with_(ORDER_ID, "select doc_id, 'ORDER_ID' as type, v as value from OH where cast(v as bigint) % 2 = 1"))
def registered_pattern(spark, sf):
    """A user-defined type: order numbers, odd ones valid."""
    own = D.register_pattern((), "ORDER_ID", r"(?<=order )\d+(?= shipped)", lambda v, c: v.cast("bigint") % 2 == 1)
    return D.scan(corpus(spark, sf), patterns=own).select("doc_id", "type", "value")


# --- strict profile ----------------------------------------------------------------------------------------------

STRICT_SRC = f"{O.C}, SD as (select k as doc_id, text from C)"
_S_PREV = "case when i = 1 then '' else substr(text, i - 1, 1) end"
STRICT_HITS = f"""SP as (select doc_id, text, i, case when i = 1 then '' else substr(text, i - 1, 1) end as prev, substr(text, i) as rest from (select doc_id, text, unnest(range(1, length(text) + 1)) as i from SD)),
SA as (select doc_id, text, i - 1 as s, v from (select *, regexp_extract(rest, '^(?:[0-9]{{4}}[ \\-][0-9]{{4}}[ \\-][0-9]{{4}}|[0-9]{{12}})') as v from SP) where v <> '' and not regexp_matches(prev, '[0-9]')
  and not (regexp_full_match(v, '[0-9]{{12}}') and prev = '+') and not regexp_matches(substr(rest, length(v) + 1, 1), '[0-9]')),
SA2 as (select *, s + length(v) as e from SA),
SA3 as (select *, {O.verhoeff('v')} as valid, {O.has(O.window(100), dims.STRICT_AADHAAR_CONTEXT)} as named from SA2 where not regexp_matches(regexp_replace(v, '[^0-9]', '', 'g'), '^91[6-9]')),
SAF as (select doc_id, text, 0 as ord, 'IN_AADHAAR' as type, s, e, v, cast(case when valid and named then 0.98 when valid then 0.95 else 0.45 end as decimal(6,3)) as conf from SA3 where valid or named),
SPP as (select doc_id, text, i - 1 as s, i - 1 + length(v) as e, v from (select *, regexp_extract(rest, '^(?:\\+91|91)[\\s\\-]?[6-9][0-9]{{9}}') as v from SP) where v <> '' and not regexp_matches(prev, '[0-9]') and not regexp_matches(substr(rest, length(v) + 1, 1), '[0-9]')),
SPP2 as (select * from SPP a where not exists (select 1 from SPP b where b.doc_id = a.doc_id and b.s < a.s and a.s < b.e)),
SPB as (select doc_id, text, i - 1 as s, i - 1 + length(v) as e, v from (select *, regexp_extract(rest, '^[6-9][0-9]{{9}}') as v from SP) where v <> '' and not regexp_matches(prev, '[0-9]') and not regexp_matches(substr(rest, length(v) + 1, 1), '[0-9]')),
SPB2 as (select * from SPB b where {O.has(O.window(80), dims.STRICT_PHONE_CONTEXT)} and not exists (select 1 from SPP2 p where p.doc_id = b.doc_id and p.s < b.e and b.s < p.e)),
SPH as (select doc_id, text, 1 as ord, 'PHONE_NUMBER_INDIA' as type, s, e, v, cast(0.88 as decimal(6,3)) as conf from SPP2 union all select doc_id, text, 1, 'PHONE_NUMBER_INDIA', s, e, v, cast(0.72 as decimal(6,3)) from SPB2),
SPAN as (select doc_id, text, 2 as ord, 'IN_PAN' as type, s, e, v, cast(0.9 as decimal(6,3)) as conf from (select doc_id, text, i - 1 as s, i - 1 + length(v) as e, v from (select *, regexp_extract(rest, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b') as v from SP) where v <> '' and not regexp_matches(prev, '\\w')) where {O.pan_shape('v')}),
SCD as (select doc_id, text, 6 as ord, 'IN_CARD' as type, s, e, v, cast(0.85 as decimal(6,3)) as conf from (select doc_id, text, i - 1 as s, i - 1 + length(v) as e, v from (select *, regexp_extract(rest, '^(?:[0-9]{{4}}[ \\-][0-9]{{4}}[ \\-][0-9]{{4}}[ \\-][0-9]{{4}}|[0-9]{{16}})') as v from SP) where v <> '' and not regexp_matches(prev, '\\w') and not regexp_matches(substr(rest, length(v) + 1, 1), '\\w')) where {O.luhn('v')}),
SEM as (select doc_id, text, 8 as ord, 'EMAIL_ADDRESS' as type, s, e, v, cast(1 as decimal(6,3)) as conf from (select doc_id, text, i - 1 as s, i - 1 + length(v) as e, v from (select *, regexp_extract(rest, '^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') as v from SP) where v <> '' and not regexp_matches(prev, '\\w'))),
SV as (select * from SAF union all select * from SPH union all select * from SPAN union all select * from SCD union all select * from SEM),
{O.resolved('SV', 'SF')}"""


@query("strict_findings", O.with_(f"{STRICT_SRC}, {STRICT_HITS}", "select doc_id, type, v as value, cast(s as int) as start_pos, cast(conf as double) as confidence from SF"))
def strict_findings(spark, sf):
    return D.scan(corpus(spark, sf), "strict").select("doc_id", "type", "value", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"))


# --- validators --------------------------------------------------------------------------------------------------

VALUES = f"{O.C}, VV as (select k, text from C)"
BASE = O.CORPUS_SQL[O.CORPUS_SQL.index("(select c_custkey as k,"):O.CORPUS_SQL.index("select k, concat('repo'")].rstrip().rstrip(")") + ")"


def _base(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer")
    return spark.sql("select * from " + BASE.replace("from customer)", "from {customer})"), customer=customer)


B = f"B as {BASE}"


@query("luhn_valid", O.with_(B, f"select k, {O.luhn('card')} as ok from B"))
def luhn_valid(spark, sf):
    return _base(spark, sf).select("k", V.luhn_ok(F.col("card")).alias("ok"))


@query("verhoeff_valid", O.with_(B, f"select k, {O.verhoeff('aadhaar')} as ok from B"))
def verhoeff_valid(spark, sf):
    return _base(spark, sf).select("k", V.verhoeff_ok(F.col("aadhaar")).alias("ok"))


@query("pan_valid", O.with_(B, f"select k, {O.pan_shape('pan')} as ok from B"))
def pan_valid(spark, sf):
    return _base(spark, sf).select("k", V.pan_ok(F.col("pan")).alias("ok"))


SSN_OK = "substr(ssn, 1, 3) not in ('000', '666') and substr(ssn, 5, 2) <> '00' and substr(ssn, 8, 4) <> '0000'"
CTX = "case k % 5 when 0 then 'a test row' when 1 then 'size 4 cm' when 2 then 'a sample' when 3 then 'my number' else '' end"


def _ctx():
    k = F.col("k") % 5
    return F.when(k == 0, "a test row").when(k == 1, "size 4 cm").when(k == 2, "a sample").when(k == 3, "my number").otherwise("")


@query("ssn_rules", O.with_(B, f"""select k, {SSN_OK} and not {O.has('ctx', dims.TECHNICAL_CONTEXT)} and not {O.has('ctx', dims.DUMMY_CONTEXT)} as live,
 {SSN_OK} and {O.CALM} as strict from (select *, {CTX} as ctx from B)"""))
def ssn_rules(spark, sf):
    return _base(spark, sf).select("k", V.ssn_ok(F.col("ssn"), _ctx()).alias("live"), V.ssn_ok(F.col("ssn"), _ctx(), "strict").alias("strict"))


@query("phone_rules", O.with_(B, f"select k, regexp_full_match(n, '[6-9][0-9]{{9}}') as live, regexp_full_match(n, '[6-9][0-9]{{9}}') and {O.CALM} as strict "
       f"from (select k, {CTX} as ctx, case when k % 2 = 0 then phone else concat('5', substr(phone, 2)) end as n from B)"))
def phone_rules(spark, sf):
    value = F.concat(F.lit("+91-"), F.when(F.col("k") % 2 == 0, F.col("phone")).otherwise(F.concat(F.lit("5"), F.substring("phone", 2, 9))))
    return _base(spark, sf).select("k", V.phone_ok(value).alias("live"), V.phone_ok(value, _ctx(), "strict").alias("strict"))


@query("card_rules", O.with_(B, f"select k, {O.luhn('card')} and {O.CALM} as ok from (select *, {CTX} as ctx from B)"))
def card_rules(spark, sf):
    return _base(spark, sf).select("k", V.card_ok(F.col("card"), _ctx()).alias("ok"))


@query("aadhaar_rules", O.with_(B, f"select k, regexp_full_match(aadhaar, '[2-9][0-9]{{11}}') and not {O.has('ctx', dims.AADHAAR_VETO)} as ok from (select *, {CTX} as ctx from B)"))
def aadhaar_rules(spark, sf):
    return _base(spark, sf).select("k", V.aadhaar_ok(F.col("aadhaar"), _ctx()).alias("ok"))


@query("gstin_valid", O.with_(O.I, f"select k, substr(gstin, 1, 2) between '01' and '37' and {O.pan_shape('substr(gstin, 3, 10)')} as ok from I"))
def gstin_valid(spark, sf):
    return identity(spark, sf).select("k", V.gstin_ok(F.col("gstin")).alias("ok"))


@query("upi_valid", O.with_(O.I, "select k, regexp_full_match(lower(upi), '[a-z0-9.\\-_]{2,256}@[a-z]{2,64}') as ok, split_part(upi, '@', 2) in ('okaxis', 'ybl') as known from I"))
def upi_valid(spark, sf):
    return identity(spark, sf).select("k", V.upi_ok(F.col("upi")).alias("ok"), V.upi_known_handle(F.col("upi")).alias("known"))


@query("abha_valid", O.with_(O.I, "select k, regexp_full_match(abha, '[0-9]{2}(-[0-9]{4}){3}') as ok, false as bare from I"))
def abha_valid(spark, sf):
    bare = F.replace("abha", F.lit("-"), F.lit(""))
    return identity(spark, sf).select("k", V.abha_ok(F.col("abha")).alias("ok"), V.abha_ok(bare).alias("bare"))


@query("passport_valid", O.with_(O.I, "select k, regexp_full_match(passport, '[A-PR-WY][1-9][0-9]{6}') as ok from I"))
def passport_valid(spark, sf):
    return identity(spark, sf).select("k", V.passport_ok(F.lower("passport")).alias("ok"))


@query("dl_valid", O.with_(O.I, "select k, regexp_full_match(dl, '[A-Z]{2}[0-9]{13}') as ok from I"))
def dl_valid(spark, sf):
    return identity(spark, sf).select("k", V.licence_ok(F.col("dl")).alias("ok"))


@query("shape_checks", O.with_(O.I, "select k, regexp_full_match(voter, '[A-Z]{3}[0-9]{7}') as voter_ok, regexp_full_match(ifsc, '[A-Z]{4}0[A-Z0-9]{6}') as ifsc_ok, false as mail_ok from I"))
def shape_checks(spark, sf):
    return identity(spark, sf).select("k", V.shape_ok(F.lower("voter"), "VOTER_ID").alias("voter_ok"), V.shape_ok(F.lower("ifsc"), "IFSC").alias("ifsc_ok"), V.shape_ok(F.col("upi"), "EMAIL").alias("mail_ok"))


NAME = "case p_partkey % 5 when 0 then p_name when 1 then concat(p_name, '()') when 2 then concat('self ', p_name) when 3 then replace(p_name, ' ', '_') else concat(p_name, ' a b c d') end"


@query("code_artifacts", f"""select p_partkey, (regexp_matches(n, '[(\\[.<=>{{}}/\\\\]') or len(string_split_regex(trim(n), '\\s+')) > 5
 or len(list_intersect(string_split_regex(trim(n), '\\s+'), ['def','class','import','return','lambda','async','await','yield','pass','raise','except','finally','None','True','False','self','cls'])) > 0 or regexp_matches(n, '^[a-z].*_')) as artifact, false as other_type
 from (select p_partkey, {NAME} as n from part)""")
def code_artifacts(spark, sf):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    value = (F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("()"))).when(k == 2, F.concat(F.lit("self "), n))
             .when(k == 3, F.replace(n, F.lit(" "), F.lit("_"))).otherwise(F.concat(n, F.lit(" a b c d"))))
    part = table(spark, sf, "part").select("p_partkey", value.alias("v"))
    return part.select("p_partkey", V.is_code_artifact(F.col("v"), F.lit("PERSON")).alias("artifact"), V.is_code_artifact(F.col("v"), F.lit("EMAIL")).alias("other_type"))


# --- shape of findings -------------------------------------------------------------------------------------------


@query("mask_values", O.with_(O.I, "select k, " + ", ".join(
    f"case when length({c}) > 8 then concat(substr({c}, 1, 4), '****', substr({c}, -4)) else concat(substr({c}, 1, 2), '****') end as m_{c}" for c in ("passport", "upi", "abha")) + " from I"))
def mask_values(spark, sf):
    from leakscope.functions.text import mask

    return identity(spark, sf).select("k", *[mask(F.col(c)).alias(f"m_{c}") for c in ("passport", "upi", "abha")])


@query("snippets", O.with_(O.F, f"select doc_id, cast(s as int) as start_pos, trim({O.window(10)}) as snippet, {O.window(5)} as around from F"))
def snippets(spark, sf):
    from leakscope.functions.text import context, snippet

    docs = corpus(spark, sf).select("doc_id", "text")
    found = corpus_findings(spark, sf).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))
    both = found.join(docs, "doc_id")
    return both.select("doc_id", "start_pos", snippet(F.col("text"), F.col("start_pos"), F.col("end_pos"), 10).alias("snippet"),
                       context(F.col("text"), F.col("start_pos"), F.col("end_pos"), 5).alias("around"))


@query("risk_class", O.with_(O.F, f"select doc_id, type, cast(s as int) as start_pos, {O.RISK} as risk, case when conf >= 0.7 then 'High' else {O.RISK} end as risk_in_context from F"))
def risk_class(spark, sf):
    found = corpus_findings(spark, sf)
    severity = S.leak_severity(F.when(F.col("confidence") >= 0.7, F.col("confidence")))
    return found.select("doc_id", "type", F.col("start").alias("start_pos"), S.risk_class(F.col("type")).alias("risk"), S.risk_class(F.col("type"), severity).alias("risk_in_context"))


@query("severity_tiers", "select o_orderkey, case when s >= 9 then 'Critical' when s >= 7 then 'High' when s >= 5 then 'Medium' when s >= 2.5 then 'Low' else 'Info' end as tier, "
       "case when s >= 9 then 'CRITICAL' when s >= 7 then 'HIGH' when s >= 5 then 'MEDIUM' when s >= 2.5 then 'LOW' else 'INFO' end as label, "
       "case when s >= 8 then 'Critical' when s >= 6 then 'High' when s >= 4 then 'Medium' else 'Low' end as band "
       "from (select o_orderkey, cast(o_orderkey % 101 as decimal(6,1)) / 10 as s from orders)")
def severity_tiers(spark, sf):
    s = ((F.col("o_orderkey") % 101).cast("decimal(6,1)") / 10).cast("decimal(4,1)")
    return table(spark, sf, "orders").select("o_orderkey", S.severity_tier(s).alias("tier"), S.ess_label(s).alias("label"), S.ess_band_ui(s).alias("band"))


@query("redacted_text", O.with_(O.F, f"""select d.doc_id, case when f.doc_id is null then d.text else f.t end as text, cast(coalesce(f.n, 0) as int) as redactions from D d left join (
 select doc_id, max(n) as n, string_agg(piece, '' order by s) || substr(any_value(text), max(e) + 1) as t from (
  select doc_id, text, s, e, count(*) over (partition by doc_id) as n, concat(substr(text, lag(e, 1, 0) over (partition by doc_id order by s) + 1, s - lag(e, 1, 0) over (partition by doc_id order by s)), value_masked) as piece from F) group by doc_id) f on d.doc_id = f.doc_id"""))
def redacted_text(spark, sf):
    return redact_documents(corpus(spark, sf)).select("doc_id", "text", "redactions")


@query("redacted_documents", O.with_(DOC_LIST, """select d.doc_id, cast(length(d.text) - coalesce(sum(length(f.v)), 0) + coalesce(sum(length(f.type) + 2), 0) as bigint) as chars, cast(count(f.v) as int) as redactions
 from documents d left join DF f using (doc_id) group by d.doc_id, d.text"""))
def redacted_documents(spark, sf):
    out = redact_documents(table(spark, sf, "documents"), mode="label")
    return out.select("doc_id", F.length("text").cast("bigint").alias("chars"), "redactions")


# --- identity documents ------------------------------------------------------------------------------------------

TITLES = ["'Government of India '", "'UIDAI enrolment '", "'Income Tax Department pan card '", "'Republic of India Passport '", "'driving licence no, valid till '", "'Election Commission voter '", "''"]


def _titled(spark, sf) -> DataFrame:
    k = F.col("doc_id") % 7
    title = F.lit("")
    for i, t in enumerate(TITLES[:-1]):
        title = F.when(k == i, F.lit(t.strip("'"))).otherwise(title)
    return table(spark, sf, "documents").select("doc_id", F.concat(title, "text").alias("text"))


TITLED = "(select doc_id, concat(case doc_id % 7 " + " ".join(f"when {i} then {t}" for i, t in enumerate(TITLES[:-1])) + " else '' end, text) as text from documents)"
COUNTS = ", ".join("(" + " + ".join(f"cast(contains(lower(text), {O.q(m)}) as int)" for m in ms) + f") as n_{name}" for name, ms in dims.DOCUMENT_MARKERS.items())
TOP = "greatest(" + ", ".join(f"n_{n}" for n in dims.DOCUMENT_MARKERS) + ")"


@query("classify_documents", f"select doc_id, case when {TOP} = 0 then 'unknown' " + " ".join(f"when n_{n} = {TOP} then '{n}'" for n in dims.DOCUMENT_MARKERS) + f" end as document_type from (select doc_id, {COUNTS} from {TITLED})")
def classify_documents(spark, sf):
    return classify_document(_titled(spark, sf)).select("doc_id", "document_type")


KYC = "(" + " or ".join(f"contains(upper(text), {O.q(p)})" for p in dims.KYC_PHRASES) + ")"


@query("kyc_flag", f"select doc_id, {KYC} as kyc from {TITLED}")
def kyc_flag(spark, sf):
    return _titled(spark, sf).select("doc_id", is_kyc(F.col("text")).alias("kyc"))


@query("kyc_findings", f"select doc_id, 'KYC_SCAN' as type, '[KYC Document]' as value, cast(10 as double) as base_score, 'Critical' as severity_tier, cast(0.95 as double) as confidence, true as is_ocr_derived from {TITLED} where {KYC}")
def kyc_scan(spark, sf):
    return kyc_findings(_titled(spark, sf)).select("doc_id", "type", "value", dbl("base_score").alias("base_score"), "severity_tier", dbl("confidence").alias("confidence"), "is_ocr_derived")


@query("document_types", f"select document_type, count(*) as documents from (select case when {TOP} = 0 then 'unknown' " + " ".join(f"when n_{n} = {TOP} then '{n}'" for n in dims.DOCUMENT_MARKERS) + f" end as document_type from (select doc_id, {COUNTS} from {TITLED})) group by document_type")
def document_types(spark, sf):
    return _titled(spark, sf).groupBy(document_type(F.col("text")).alias("document_type")).agg(F.count(F.lit(1)).alias("documents"))


# --- invented data, context --------------------------------------------------------------------------------------

FIRST_WORD = "case " + " ".join(f"when contains(lower(snippet), {O.q(w)}) then {O.q(w)}" for w in dims.FAKE_KEYWORDS) + " end"
FAKE = f"""FK as (select *, {O.CANON} in ({', '.join(O.q(t) for t in dims.FAKE_ELIGIBLE)}) as eligible, {FIRST_WORD} as word from (select * replace (concat(case when doc_id % 3 = 0 then 'a demo ' when doc_id % 3 = 1 then '' else 'latest ' end, snippet) as snippet) from F)),
FK2 as (select *, case when eligible and word is not null then round(conf * cast(0.24 as decimal(3,2)), 3) else conf end as c2 from FK)"""


@query("fake_filter", O.with_(f"{O.F}, {FAKE}", """select doc_id, type, cast(s as int) as start_pos, cast(c2 as double) as confidence,
 case when eligible and word is not null then concat('fast regex match; NLP: likely fake (keyword match: ', word, ', p=0.95)') else 'fast regex match' end as annotation from FK2 where not eligible or c2 >= 0.15"""))
def fake_filter(spark, sf):
    found = corpus_findings(spark, sf)
    lead = F.when(F.col("doc_id") % 3 == 0, "a demo ").when(F.col("doc_id") % 3 == 1, "").otherwise("latest ")
    out = filter_fake(found.withColumn("snippet", F.concat(lead, "snippet")))
    return out.select("doc_id", "type", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"), "annotation")


LEXICAL = f"""case when {O.has('text', dims.TECHNICAL_CONTEXT)} then 0.30 when {O.has('text', r'\b(leaked|disclosed|exposed|accidentally|mistakenly|confidential)\b')} then 0.84
 when {O.has('text', dims.OWNERSHIP)} then 0.62 else 0.50 end"""
CONTEXT = f"""CX as (select *, case when type = 'CREDIT_CARD' then 0.87 else case when {O.has('text', dims.TECHNICAL_CONTEXT)} then least({LEXICAL}, 0.52) else {LEXICAL} end end as b from hitsok),
CX1 as (select *, case when {O.has('text', dims.PII_KEYWORDS)} then greatest(b, 0.70) else b end as b1 from CX),
CX2 as (select *, case when {O.has('text', dims.OWNERSHIP)} then least(b1 + 0.10, 1.0) else b1 end as b2 from CX1),
CX3 as (select doc_id, text, ord, type, s, e, v, cast(b2 as decimal(6,3)) as conf from CX2 where b2 >= 0.58)"""
HITS_OK = ("hitsok as (select * from (select *, " + O.window(100) + " as ctx from hits) where (case type " + " ".join(f"when {O.q(t)} then {c}" for t, c in O.LIVE_CHECK.items())
           + f" else true end) and not {O.has('v', dims.MASKED_VALUE)} and not {O.has('text', dims.DUMMY_CONTEXT)})")
CONTEXT_CTES = ",\n".join([O.C, O.D, O.raw_ctes("D"), HITS_OK, CONTEXT, O.resolved("CX3", "CF")])


@query("context_score", O.with_(CONTEXT_CTES, "select doc_id, type, cast(s as int) as start_pos, cast(conf as double) as confidence, case when conf >= 0.82 then 'Critical' else 'High' end as risk from CF"))
def context_score(spark, sf):
    """The context profile with the lexical class probabilities, all in one stage."""
    return D.scan(corpus(spark, sf), "context").select("doc_id", "type", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"), "risk")


def _lexical_frames(frames):
    """The same classes as a pandas classifier, as a user would plug in a model."""
    import re

    order = [(re.compile(dims.TECHNICAL_CONTEXT, re.I), (0.30, 0.20, 0.05, 0.05, 0.40)),
             (re.compile(r"\b(leaked|disclosed|exposed|accidentally|mistakenly|confidential)\b", re.I), (0.84, 0.10, 0.02, 0.02, 0.02)),
             (re.compile(dims.OWNERSHIP, re.I), (0.62, 0.20, 0.06, 0.06, 0.06))]
    names = [dims.HIGH_RISK_LABELS[0], dims.MID_RISK_LABELS[0], *dims.LOW_RISK_LABELS]

    def classify(sentence):
        for regex, row in order:
            if regex.search(sentence):
                return dict(zip(names, row))
        return dict(zip(names, (0.50, 0.30, 0.10, 0.05, 0.05)))

    for frame in frames:
        yield frame.assign(scores=[classify(s) for s in frame["sentence"]])


ENTITY = "EN as (select doc_id, 0 as es, 2 as ee from D where doc_id % 4 = 0)"
PERSONS = ",\n".join([O.C, O.D, O.raw_ctes("D"), HITS_OK, CONTEXT.replace(
    "CX3 as (select doc_id, text, ord, type, s, e, v, cast(b2 as decimal(6,3)) as conf from CX2 where b2 >= 0.58)",
    "CX3 as (select doc_id, text, ord, type, s, e, v, conf from (select *, cast(case when doc_id % 4 = 0 then least(b2 + 0.07, 1.0) else b2 end as decimal(6,3)) as conf from CX2) where conf >= 0.58)"),
    O.resolved("CX3", "CF")])


@query("context_with_entities", O.with_(PERSONS, "select doc_id, type, cast(s as int) as start_pos, cast(conf as double) as confidence, case when conf >= 0.82 then 'Critical' else 'High' end as risk from CF"))
def context_with_entities(spark, sf):
    """The joined form: every distinct sentence classified once in Python, person entities from a table."""
    docs = corpus(spark, sf)
    people = docs.filter(F.col("doc_id") % 4 == 0).select("doc_id", F.lit("PERSON").alias("label"), F.lit(0).alias("s"), F.lit(2).alias("e"))
    out = X.scan_in_context(docs, scorer=_lexical_frames, entities=people)
    return out.select("doc_id", "type", F.col("start").alias("start_pos"), dbl("confidence").alias("confidence"), "risk")


SENT = r"select doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', concat('\1', chr(30)), 'g'), '\x1e|\n+')) as sentence from documents"


@query("sentence_counts", f"select doc_id, count(*) as sentences, cast(sum(length(sentence)) as bigint) as chars from ({SENT}) where sentence <> '' group by doc_id")
def sentence_counts(spark, sf):
    return X.split_sentences(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("text")).alias("chars"))


CUT = r"string_split_regex(regexp_replace({}, '([.!?])\s+', concat('\1', chr(30)), 'g'), '\x1e|\n')"


@query("sentence_of_span", O.with_(DOC_LIST, f"select doc_id, cast(s as int) as start_pos, type, {CUT.format('text')}[len({CUT.format('substr(text, 1, s)')})] as sentence from DF"))
def sentence_of_span(spark, sf):
    """Sentences are landed in buckets by document and offset; spans meet them without moving a text."""
    docs, run = table(spark, sf, "documents"), uuid.uuid4().hex
    spans = checkpointed(D.scan(docs, filename=None).select("doc_id", "type", "start", "end"))
    sentences = land_bucketed(X.split_sentences(docs), f"sentences_{run}", f"{shared_folder(spark).rstrip('/')}/sentences-{run}", ("doc_id", "s"), 8)
    out = X.sentence_of_span(spans, sentences)
    return out.select("doc_id", F.col("start").alias("start_pos"), "type", "sentence")


@query("entities_near", O.with_(O.F, """select f.doc_id, cast(f.s as int) as start_pos, coalesce(string_agg(distinct e.label, ',' order by e.label), '') as labels from F f
 left join (select doc_id, 'ORG' as label, 0 as s, 3 as e from D union all select doc_id, 'PERSON', cast(length(text) - 2 as bigint), cast(length(text) as bigint) from D where doc_id % 3 = 0
 union all select doc_id, 'DATE', 4000, 4004 from D) e on e.doc_id = f.doc_id and e.s >= f.s - 200 and e.e <= f.e + 200 group by f.doc_id, f.s"""))
def entities_near(spark, sf):
    docs = corpus(spark, sf)
    ent = lambda label, s, e: docs.select("doc_id", F.lit(label).alias("label"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    ents = ent("ORG", F.lit(0), F.lit(3)).unionByName(
        docs.filter(F.col("doc_id") % 3 == 0).select("doc_id", F.lit("PERSON").alias("label"), (F.length("text") - 2).alias("s"), F.length("text").alias("e"))
    ).unionByName(ent("DATE", F.lit(4000), F.lit(4004)))
    spans = corpus_findings(spark, sf).select("doc_id", "start", "end")
    return X.entities_near(spans, ents).select("doc_id", F.col("start").alias("start_pos"), joined("labels").alias("labels"))


@query("handles", "select c_custkey, concat('u', c_custkey) as forum, concat('u', c_custkey) as twitter, concat('u', c_custkey) as professional, concat('u', c_custkey) as channel, concat('u', c_custkey) as repo_user from customer")
def handles(spark, sf):
    u = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    return table(spark, sf, "customer").select(
        "c_custkey", normalise_handle(c("u/", u, " "), "forum").alias("forum"), normalise_handle(c(" @@", u), "twitter").alias("twitter"),
        normalise_handle(c("https://www.linkedin.com/in/", u, "/"), "professional").alias("professional"),
        normalise_handle(c(" @", u), "channel").alias("channel"), normalise_handle(c("https://github.com/", u, "//"), "profile_repo_user").alias("repo_user"))
