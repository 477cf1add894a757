"""SQL twins of the queries: an independent reading of the rules for DuckDB.

Detection is restated by brute force: every position of every text is a candidate start, look-around becomes a test of
the neighbouring characters, and the two greedy choices are list folds.
"""
from __future__ import annotations

from leakscope import dims
from leakscope.sources.corpus import CORPUS_SQL

C = f"C as ({CORPUS_SQL})"
D = "D as (select k as doc_id, platform, container, path, concat('https://example.org/', container, '/', path, '#', k) as source_url, text from C)"

# Identity corpus: document numbers that the leak corpus lacks, from the part table.
IDENTITY_SQL = """
select k, case k % 8
  when 0 then concat('passport ', passport, ' kept') when 1 then concat('voter id ', voter, ' here')
  when 2 then concat('licence ', dl, ' ok') when 3 then concat('ifsc ', ifsc, ' branch')
  when 4 then concat('gst no ', gstin, ' paid') when 5 then concat('pay ', upi, ' soon')
  when 6 then concat('health id ', abha, ' seen')
  else concat(passport, ' ', voter, ' ', dl, ' ', ifsc, ' ', upi) end as text,
 passport, voter, dl, ifsc, gstin, upi, abha
from (select p_partkey as k,
 concat(chr(cast(65 + p_partkey % 26 as int)), lpad(cast((p_partkey * 7919 + 1234567) % 10000000 as varchar(20)), 7, '0')) as passport,
 concat(chr(cast(65 + p_partkey % 26 as int)), chr(cast(65 + (p_partkey * 3) % 26 as int)), chr(cast(65 + (p_partkey * 5) % 26 as int)), lpad(cast((p_partkey * 104729) % 10000000 as varchar(20)), 7, '0')) as voter,
 concat(chr(cast(65 + (p_partkey * 7) % 26 as int)), chr(cast(65 + (p_partkey * 11) % 26 as int)), lpad(cast(p_partkey % 100 as varchar(20)), 2, '0'), case when p_partkey % 3 = 0 then ' ' else '' end, lpad(cast((p_partkey * 48271) % 100000000000 as varchar(20)), 11, '0')) as dl,
 concat(chr(cast(65 + p_partkey % 26 as int)), chr(cast(65 + (p_partkey * 9) % 26 as int)), 'BK0', lpad(cast(p_partkey % 1000000 as varchar(20)), 6, '0')) as ifsc,
 concat(lpad(cast(p_partkey % 42 as varchar(20)), 2, '0'), chr(cast(65 + p_partkey % 26 as int)), 'BC', substring('CPHABGJLFTEXYZ', cast(1 + p_partkey % 14 as int), 1), 'E', lpad(cast(p_partkey % 10000 as varchar(20)), 4, '0'), 'F', cast(1 + p_partkey % 9 as varchar(20)), 'Z', cast(p_partkey % 10 as varchar(20))) as gstin,
 concat('user', cast(p_partkey as varchar(20)), '@', case p_partkey % 4 when 0 then 'okaxis' when 1 then 'ybl' when 2 then 'zz' else 'bank' end) as upi,
 concat(lpad(cast(p_partkey % 100 as varchar(20)), 2, '0'), '-', lpad(cast((p_partkey * 31) % 10000 as varchar(20)), 4, '0'), '-', lpad(cast((p_partkey * 37) % 10000 as varchar(20)), 4, '0'), '-', lpad(cast((p_partkey * 41) % 10000 as varchar(20)), 4, '0')) as abha
 from part) b
"""
I = f"I as ({IDENTITY_SQL})"  # noqa: E741

WORD = r"[\p{L}\p{M}\p{N}_]"
EDGE = f"(regexp_matches(prev, '{WORD}') <> regexp_matches(substr(rest, 1, 1), '{WORD}'))"
NO_DIGIT_BEFORE = "not regexp_matches(prev, '[0-9]')"
NO_DIGIT_AFTER = "not regexp_matches(nxt, '[0-9]')"
# type -> (anchored RE2 pattern, condition on the character before, condition on the character after)
RULES = {
    "AADHAAR": (r"^[1-9][0-9]{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}", NO_DIGIT_BEFORE, NO_DIGIT_AFTER),
    "PAN": (r"^[A-Z]{5}[0-9]{4}[A-Z]\b", EDGE, "true"),
    "GSTIN": (r"^[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", EDGE, "true"),
    "PASSPORT_IN": (r"^[A-PR-WY][1-9][0-9]{6}\b", EDGE, "true"),
    "VOTER_ID": (r"^[A-Z]{3}[0-9]{7}\b", EDGE, "true"),
    "DL_IN": (r"^[A-Z]{2}[0-9]{2}\s?[0-9]{11}\b", EDGE, "true"),
    "SSN": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\b", EDGE + " and not regexp_matches(prev, '[0-9.]')", "not regexp_matches(nxt, '[0-9.]')"),
    "CREDIT_CARD": (r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6011[0-9]{12}|3[47][0-9]{13})\b", EDGE, "true"),
    "IFSC": (r"^[A-Z]{4}0[A-Z0-9]{6}\b", EDGE, "true"),
    "EMAIL": (r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", EDGE, "true"),
    "PHONE": (r"^(\+91[-\s]?)?[6-9][0-9]{9}", NO_DIGIT_BEFORE, NO_DIGIT_AFTER),
    "UPI": (r"^[a-zA-Z0-9.\-_]{2,40}@[a-zA-Z]{2,64}\b", EDGE, "true"),
    "ABHA": (r"^[0-9]{2}-[0-9]{4}-[0-9]{4}-[0-9]{4}\b", EDGE, "true"),
}


#: Findings of the corpus with every value of the same text masked in the snippet; a text has up to three findings.
MASKED = """MV as (select doc_id, list(value order by s) as vs, list(value_masked order by s) as ms from F group by doc_id),
 FM as (select F.* replace (replace(replace(replace(snippet, vs[1], ms[1]), coalesce(vs[2], '~none~'), coalesce(ms[2], '')), coalesce(vs[3], '~none~'), coalesce(ms[3], '')) as snippet)
  from F join MV using (doc_id))"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q('(?i)' + pattern)})"


def window(n: int, text: str = "text", s: str = "s", e: str = "e") -> str:
    return f"substr({text}, greatest({s} - {n}, 0) + 1, {e} + {n} - greatest({s} - {n}, 0))"


def sql_map(mapping: dict, key: str, default: str) -> str:
    return f"case {key} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in mapping.items()) + f" else {default} end"


def verhoeff(expr: str) -> str:
    digits = f"regexp_replace({expr}, '[^0-9]', '', 'g')"
    perm = f"list_transform(range(0, 12), lambda i: ({dims.VERHOEFF_P})[cast(i % 8 as int) + 1][cast(substr({digits}, cast(12 - i as int), 1) as int) + 1])"
    fold = f"list_reduce(list_prepend(0, {perm}), lambda c, x: ({dims.VERHOEFF_D})[cast(c as int) + 1][cast(x as int) + 1])"
    return f"(case when regexp_full_match({digits}, '[2-9][0-9]{{11}}') then {fold} = 0 else false end)"


def luhn(expr: str) -> str:
    digits = f"regexp_replace({expr}, '[\\s\\-]', '', 'g')"
    doubled = f"(cast(substr({digits}, cast(length({digits}) - i as int), 1) as int) * (case when i % 2 = 1 then 2 else 1 end))"
    total = f"list_sum(list_transform(range(0, length({digits})), lambda i: case when {doubled} > 9 then {doubled} - 9 else {doubled} end))"
    return f"(case when regexp_full_match({digits}, '[0-9]{{13,19}}') then {total} % 10 = 0 else false end)"


def pan_shape(expr: str) -> str:
    return f"regexp_full_match(upper({expr}), '[A-Z]{{3}}[CPHABGJLFTE][A-Z][0-9]{{4}}[A-Z]')"


LIVE_CHECK = {
    "AADHAAR": f"regexp_full_match(regexp_replace(v, '[^0-9]', '', 'g'), '[2-9][0-9]{{11}}') and not {has('ctx', dims.AADHAAR_VETO)}",
    "SSN": "substr(v, 1, 3) not in ('000', '666') and substr(v, 5, 2) <> '00' and substr(v, 8, 4) <> '0000' "
           f"and not {has('ctx', dims.TECHNICAL_CONTEXT)} and not {has('ctx', dims.DUMMY_CONTEXT)}",
}
CALM = f"not {has('ctx', dims.TECHNICAL_CONTEXT)} and not {has('ctx', dims.DUMMY_CONTEXT_BROAD)}"
FULL_CHECK = {
    "AADHAAR": f"{verhoeff('v')} and not {has('ctx', dims.AADHAAR_VETO)}",
    "PAN": pan_shape("v"),
    "GSTIN": f"substr(v, 1, 2) between '01' and '37' and {pan_shape('substr(v, 3, 10)')}",
    "DL_IN": "regexp_full_match(v, '[A-Z]{2}[0-9]{13}')",
    "SSN": f"substr(v, 1, 3) not in ('000', '666') and substr(v, 5, 2) <> '00' and substr(v, 8, 4) <> '0000' and {CALM}",
    "CREDIT_CARD": f"{luhn('v')} and {CALM}",
    "PHONE": CALM,
}


def raw_ctes(source: str, key: str = "doc_id", types: list[str] | None = None, prefix: str = "") -> str:
    """CTE {prefix}hits(key, text, ord, type, s, e, v): non-overlapping matches per pattern."""
    types = types or [t for t, _ in dims.LIVE_PATTERNS]
    parts = []
    for ordinal, name in enumerate(types):
        regex, before, after = RULES[name]
        parts.append(
            f"select {key}, {ordinal} as ord, {q(name)} as type, i - 1 as s, i - 1 + length(v) as e, v from "
            f"(select *, substr(rest, length(v) + 1, 1) as nxt from (select {key}, i, prev, rest, regexp_extract(rest, {q(regex)}) as v "
            f"from {prefix}pos) where v <> '') where {before} and {after}"
        )
    union = "\nunion all\n".join(parts)
    fold = "lambda acc, x: case when x[1].s >= acc[len(acc)].e then list_concat(acc, x) else acc end"
    return f"""{prefix}pos as (select {key}, i, prev, substr(text, i) as rest from (select {key}, text, unnest(range(1, length(text) + 1)) as i,
 unnest(list_prepend('', string_split(text, ''))[:length(text)]) as prev, unnest(string_split(text, '')) as cur from {source})
 where regexp_matches(cur, '[A-Za-z0-9+._%-]') and (not regexp_matches(prev, '{WORD}') or not regexp_matches(cur, '{WORD}'))),
{prefix}cand as ({union}),
{prefix}first as (select {key}, ord, type, unnest(list_reduce(list([{{'s': s, 'e': e, 'v': v}}] order by s), {fold})) as m from {prefix}cand group by {key}, ord, type),
{prefix}hits as (select {key}, text, ord, type, m.s as s, m.e as e, m.v as v from {prefix}first join {source} using ({key}))"""


def valid_ctes(source: str, key: str = "doc_id", types: list[str] | None = None, checks: dict | None = None, prefix: str = "") -> str:
    """... plus {prefix}valid(..., conf): validated hits with the fast confidence."""
    checks = LIVE_CHECK if checks is None else checks
    cond = "case type " + " ".join(f"when {q(t)} then {c}" for t, c in checks.items()) + " else true end"
    return raw_ctes(source, key, types, prefix) + f""",
{prefix}valid as (select {key}, text, ord, type, s, e, v, cast(case when {has(window(80), dims.PII_KEYWORDS)} then 0.750 else 0.650 end as decimal(6,3)) as conf
 from (select *, {window(100)} as ctx from {prefix}hits) where {cond})"""


def resolved(valid: str, out: str, key: str = "doc_id") -> str:
    """Greedy choice by confidence, pattern order, start."""
    fold = ("lambda acc, x: case when len(list_filter(acc, lambda h: h.s < x[1].e and x[1].s < h.e)) = 0 "
            "then list_concat(acc, x) else acc end")
    return f"""{out}_l as (select {key}, unnest(list_reduce(list([{{'s': s, 'e': e, 'v': v, 'type': type, 'conf': conf}}] order by conf desc, ord, s), {fold})) as m from {valid} group by {key}),
{out} as (select {key}, m.type as type, m.s as s, m.e as e, m.v as v, m.conf as conf from {out}_l)"""


def findings_ctes(source: str, key: str = "doc_id", types=None, checks=None, prefix: str = "", out: str = "F0") -> str:
    return valid_ctes(source, key, types, checks, prefix) + ",\n" + resolved(f"{prefix}valid", out, key)


MASK = "case when length(v) > 8 then concat(substr(v, 1, 4), '****', substr(v, -4)) else concat(substr(v, 1, 2), '****') end"
RISK = sql_map(dims.RISK, "type", "'Low'")
CANON = sql_map(dims.TYPE_ALIAS, "type", "type")
EXTENDED_TYPES = [t for t, _ in dims.EXTENDED_PATTERNS]

# F: findings of the leak corpus with provenance
F = ",\n".join([
    C, D, findings_ctes("D"),
    f"F as (select doc_id, platform, container, path, source_url, text, type, v as value, {MASK} as value_masked, "
    f"trim(replace({window(80)}, chr(10), ' ')) as snippet, conf, {RISK} as risk, s, e from F0 join D using (doc_id))",
])


def ess_ctes(findings: str, keys: list[str], source_type: str, out: str = "E", canonical: bool = True) -> str:
    """Score per source; types as an array, numbers as double."""
    kind = CANON if canonical else "type"
    weight = sql_map(dims.SENSITIVITY, "t", q(dims.DEFAULT_SENSITIVITY))
    ks = ", ".join(keys)
    ranked = sorted(dims.TOXIC_COMBOS, key=lambda c: c[1], reverse=True)
    conds = [(f"len(list_intersect({m}, types)) = {len(m)}", mult, label) for m, mult, label in ranked]
    mult = "case " + " ".join(f"when {c} then {m}" for c, m, _ in conds) + " else 1.00 end"
    label = "case " + " ".join(f"when {c} then {q(lb)}" for c, _, lb in conds) + " else 'none' end"
    radius = sql_map(dims.EXPOSURE_RADIUS, "st", "'1.00'")
    band = "case " + " ".join(f"when score >= {a} then {q(b)}" for a, b, _ in dims.ESS_BANDS) + " else 'INFO' end"
    return f"""{out}1 as (select {ks}, max({source_type}) as st, list_sort(list(distinct t)) as types, max(cast({weight} as decimal(4,1))) as base,
  cast(sum(cast(conf * 1000 as bigint)) as bigint) as m, count(*) as n from (select *, {kind} as t from {findings}) group by {ks}),
{out}2 as (select *, cast({mult} as decimal(4,2)) as mult, {label} as combo, cast({radius} as decimal(4,2)) as radius,
  cast((((1000 * n - m) * 3) * 2 + 2 * n) // (4 * n) as decimal(12,0)) * cast(0.001 as decimal(4,3)) as penalty from {out}1),
{out}3 as (select *, cast(base * mult as decimal(10,3)) as toxic, cast(base * mult * radius as decimal(14,5)) as wide from {out}2),
{out}4 as (select *, round(greatest(cast(0 as decimal(14,5)), least(cast(10 as decimal(14,5)), cast(wide - penalty as decimal(14,5)))), 2) as score from {out}3),
{out} as (select *, {band} as label from {out}4)"""


ESS_COLUMNS = ("cast(score as double) as score, cast(base as double) as base_score, combo as toxic_combo_label, cast(mult as double) as toxic_multiplier, "
               "cast(radius as double) as exposure_multiplier, cast(penalty as double) as confidence_penalty, array_to_string(types, ',') as types_found, "
               "label as ess_label, n as findings_count")


def with_(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


def summary_select(ess: str, keys: list[str]) -> str:
    """Scan summary over a score CTE, grouped by `keys` (may be empty)."""
    ks = ", ".join(keys)
    lead = f"{ks}, " if keys else ""
    group = f"group by {ks}" if keys else ""
    band = "case " + " ".join(f"when max(score) >= {a} then {q(b)}" for a, b, _ in dims.ESS_BANDS) + " else 'INFO' end"
    color = "case " + " ".join(f"when max(score) >= {a} then {q(c)}" for a, _, c in dims.ESS_BANDS) + " else '#aaaaaa' end"
    return (f"select {lead}cast(max(score) as double) as max_ess, "
            "cast((cast(sum(cast(score * 100 as bigint)) as bigint) * 2 + count(*)) // (2 * count(*)) as double) / 100 as avg_ess, "
            f"{band} as label, {color} as color, count(*) as total_sources, "
            f"array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') as all_types from {ess} {group}")
