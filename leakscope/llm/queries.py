"""The operators as named queries over the test tables, with SQL twins where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.archives import through_archives
from leakscope.llm.chat import format_conversations
from leakscope.llm.common import stored
from leakscope.llm.decontaminate import contamination_report
from leakscope.llm.divergence import source_divergence
from leakscope.llm.fim import digest, fill_in_middle, frame_store, restored
from leakscope.llm.mixing import mix_sources
from leakscope.llm.neardup import duplicate_report
from leakscope.llm.packing import pack_documents
from leakscope.llm.phrases import phrase_dedup
from leakscope.llm.pseudonyms import pseudonymise
from leakscope.llm.quality import score_quality
from leakscope.llm.suffixes import suffix_dedup
from leakscope.llm.topk import top_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A fixed demonstration key. A real run passes its own secret.
DEMO_KEY = "demonstration key"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_feistel_pseudonyms")
def feistel_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymise(table(spark, sf, "documents"), DEMO_KEY, count="n_replaced")


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION_SQL = rf"""
with words as (
  select doc_id, regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
cut as (
  select item_id, least(10, len(w)) as n, unnest([array_to_string(w[i : i + 9], ' ') for i in range(1, greatest(len(w) - 9, 1) + 1)]) as win
  from items where len(w) > 0),
lengths as (select distinct n from cut),
places as (
  select doc_id, lengths.n, unnest(range(1, len(w) - lengths.n + 2)) as i, w from words, lengths where len(w) >= lengths.n),
spots as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win from places),
found as (select distinct spots.doc_id, spots.i, spots.n, cut.item_id from spots join cut on spots.win = cut.win and spots.n = cut.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
ids as (
  select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as digest
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select words.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(digest, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits using (doc_id) left join ids using (doc_id)
"""


@query("op7_benchmark_decontamination", DECONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination_report(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("spans")


@query("op9_quality_trees")
def quality_trees(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


MIXING_SQL = """
with counts as (select source, count(*) as n_docs from documents group by source),
rates as (
  select source, sqrt(n_docs) / sum(sqrt(n_docs)) over () * sum(n_docs) over () / n_docs as rate from counts),
terms as (
  select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf
  from rates, (select unnest(range(0, 100)) as k)),
drawn as (
  select *, cast('0x' || substr(md5('42:' || cast(doc_id as varchar)), 1, 13) as bigint) / 4503599627370496.0 as u from documents),
copies as (
  select drawn.doc_id, count(*) as n from drawn join terms on drawn.source = terms.source and cdf <= u group by drawn.doc_id)
select documents.*, cast(unnest(range(1, n + 1)) as int) as copy from documents join copies using (doc_id)
"""


@query("op10_poisson_mixing", MIXING_SQL)
def poisson_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Half-way between the sources' own shares and equal shares: weights go with the square root of the counts."""
    return mix_sources(table(spark, sf, "documents"))


NEAR_DUPLICATES_SQL = f"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWERED.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest([array_to_string(w[i : i + 3], ' ') for i in range(1, greatest(len(w) - 3, 1) + 1)]) as s
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as n_both from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id),
links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * n_both >= 80 * (p.n + q.n - n_both)),
reached as (
  select doc_id as node, doc_id as other from sizes
  union
  select reached.node, links.b from reached join links on links.a = reached.other),
roots as (select node, min(other) as root from reached group by node)
select words.doc_id, coalesce(n, 0) as n_shingles, coalesce(root, words.doc_id) as component_id,
  coalesce(root, words.doc_id) = words.doc_id as kept
from words left join sizes using (doc_id) left join roots on node = words.doc_id
"""


@query("op4_minhash_near_duplicates", NEAR_DUPLICATES_SQL)
def minhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_report(table(spark, sf, "documents"), window=4)


PHRASES_SQL = r"""
with words as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
places as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from words where len(w) >= 35),
windows as (select doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) as h from places),
twice as (select h from windows group by h having count(*) > 1),
hit as (select distinct doc_id, unnest(range(i, i + 35)) as p from windows semi join twice using (h)),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from words),
kept as (
  select each.doc_id, string_agg(word, ' ' order by each.p) as text, count(*) as n
  from each anti join hit on hit.doc_id = each.doc_id and hit.p = each.p group by each.doc_id)
select words.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept using (doc_id)
"""


@query("op2_phrase_automata", PHRASES_SQL)
def phrase_automata(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_dedup(table(spark, sf, "documents"))


@query("op3_suffix_arrays")
def suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup(table(spark, sf, "documents"))


TOP_K_SQL = """
with fit as (
  select vec_id, [floor(64 * cast(x as double)) for x in embedding] as v from embeddings
  where embedding is not null and vec_id is not null
    and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from fit q join fit c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 20
"""


@query("op1_threshold_top_k", TOP_K_SQL)
def threshold_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


ARCHIVES_SQL = """
with sized as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
best as (select *, max(page_id) over (partition by payload_digest) as best from sized)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> best then best end as refers_to
from best
"""


@query("op8_legacy_archives", ARCHIVES_SQL)
def legacy_archives(spark: SparkSession, sf: str) -> DataFrame:
    return through_archives(table(spark, sf, "pages"))


CHAT_SQL = r"""
with users as (
  select u.*, len([w for w in regexp_split_to_array(u.text, '[\x09-\x0D\x20]+') if w <> '']) as words, b.turn as before
  from conversations u left join (select distinct conv_id, turn from conversations where role = 'user') b
    on b.conv_id = u.conv_id and b.turn = u.turn - 2 where u.role = 'user'),
turns as (
  select conv_id, turn, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as chain
  from (select distinct conv_id, turn from conversations where role = 'user')),
levels as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, chain order by turn) - 1 as level from turns),
calls as (
  select conv_id, turn, level, 'c' || conv_id || '-' || turn as call_id, words > 0 as valid,
    '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || ',"words":' || words || '},"depends_on":['
      || case when before is null then '' else '"c' || conv_id || '-' || before || '"' end || '],"id":"c' || conv_id || '-' || turn
      || '","name":"answer","result":' as head
  from users join levels using (conv_id, turn)),
results as (
  select conv_id, turn, 'c' || conv_id || '-' || (turn - 1) as call_id, text from conversations where role = 'assistant')
select coalesce(c.conv_id, r.conv_id) as conv_id, cast(coalesce(c.level, 0) as int) as level, coalesce(c.turn, r.turn) as turn, coalesce(c.call_id, r.call_id) as call_id,
  case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'linked' end as status,
  coalesce(c.valid, true) as valid,
  case when c.call_id is null then '{"content":' || to_json(r.text) || ',"id":"' || r.call_id || '","role":"tool"}'
    else c.head || coalesce(cast(to_json(r.text) as varchar), 'null') || '}' end as record
from calls c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
union all
select conv_id, 0, turn, null, 'plain', true, '{"content":' || to_json(text) || ',"role":"' || role || '"}'
from conversations where role not in ('user', 'assistant')
"""


@query("op5_tool_call_links", CHAT_SQL)
def tool_call_links(spark: SparkSession, sf: str) -> DataFrame:
    return format_conversations(table(spark, sf, "conversations")).drop("errors")


FILL_IN_MIDDLE_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
    cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from cut),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, substring(t, 1, lo) as prefix, substring(t, lo + 1, hi - lo) as middle, substring(t, hi + 1) as suffix from placed)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""


@query("op11_fill_in_middle", FILL_IN_MIDDLE_SQL)
def fill_in_middle_digests(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_in_middle(stored(frame_store(table(spark, sf, "documents")), "frames"), seed=1)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query("op12_balanced_packing")
def balanced_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


DIVERGENCE_SQL = rf"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select d, lang, source, unnest(regexp_extract_all({LOWERED.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct d) >= {{docs}}),
langs as (select lang, sum(n) as n_lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as k from words semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(k) as n_group from counts group by lang, source),
shares as (
  select g.lang, g.source, kept.term, coalesce(k, 0) as k,
    cast(1 + (cast(1000000000 as hugeint) * (coalesce(k, 0) + 1)) // (coalesce(n_group, 0) + v) as bigint) as p,
    cast(1 + (cast(1000000000 as hugeint) * (kept.n + 1)) // (n_lang + v) as bigint) as q
  from groups g join kept on kept.lang = g.lang join langs on langs.lang = g.lang
  left join totals on totals.lang = g.lang and totals.source = g.source
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
pairs as (
  select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from shares where k > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {{top}}
"""


@query("op13_source_divergence", DIVERGENCE_SQL.format(docs=3, top=200))
def divergence_audit(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))
