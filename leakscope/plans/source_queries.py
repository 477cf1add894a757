"""Queries: sources, scan pipelines, history, profiles, alerts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leakscope import dims
from leakscope.operators import history as H
from leakscope.operators import rollups as R
from leakscope.operators.numbering import shared_folder
from leakscope.plans import oracle_sql as O
from leakscope.plans import scans as P
from leakscope.plans.registry import corpus, dbl, joined, query, table
from leakscope.sources import channels as CH
from leakscope.sources import files as FL
from leakscope.sources import pastes as PA
from leakscope.sources import sinks as SK
from leakscope.sources import social as SO
from leakscope.sources.layout import spread
from leakscope.streaming import alerts as A

# --- file listings -----------------------------------------------------------------------------------------------

DIRS = ["src", "Node_Modules/x", "a/public/b", "docs", "lib/.git", ""]
NAMES = ["app.py", ".env", "prod.env", ".env.local", "scan.PDF", "build", "notes.tar.gz", "x.TFVARS", "img.webp"]
PATH = ("concat(case p_partkey % 6 " + " ".join(f"when {i} then '{d}/'" for i, d in enumerate(DIRS[:-1])) + " else '' end, 'f', p_partkey % 40, '_', case p_partkey % 9 "
        + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NAMES)) + " end)")
BARE = PATH.replace("'f', p_partkey % 40, '_', ", "")
TREE = f"(select concat('repo', p_partkey % 25) as repo, case when p_partkey % 3 = 0 then 'master' else 'main' end as branch, case when p_partkey % 4 = 3 then {BARE} else {PATH} end as path, case when p_partkey % 11 = 0 then 'tree' else 'blob' end as type, p_partkey * 997 % 1100000 as size, p_partkey from part)"


def _tree(spark, sf):
    k = F.col("p_partkey")
    pick = lambda values, n, end: F.get(F.array(*[F.lit(v + end if v else "") for v in values]), (k % n).cast("int"))
    base = F.concat(pick(DIRS, 6, "/"), F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("f"), (k % 40).cast("string"), F.lit("_"))), pick(NAMES, 9, ""))
    return table(spark, sf, "part").select(
        F.concat(F.lit("repo"), (k % 25).cast("string")).alias("repo"), F.when(k % 3 == 0, "master").otherwise("main").alias("branch"),
        base.alias("path"), F.when(k % 11 == 0, "tree").otherwise("blob").alias("type"), (k * 997 % 1100000).alias("size"), "p_partkey")


_LAST = "regexp_extract(path, '[^/]*$')"
SUFFIX = f"lower(regexp_extract({_LAST}, '^.+(\\.[^.]+)$', 1))"
SKIPPED = "len(list_intersect(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), [" + ", ".join(O.q(d) for d in dims.SKIP_DIRS) + "])) > 0"
ROUTE = (f"case when {SUFFIX} in ({', '.join(O.q(s) for s in dims.TEXT_SUFFIXES)}) then 'text' "
         f"when {SUFFIX} in ({', '.join(O.q(s) for s in dims.OCR_SUFFIXES)}) then 'ocr' else 'skip' end")


@query("route_files", f"select p_partkey, path, {_LAST} as name, {ROUTE} as route from {TREE}")
def route_files(spark, sf):
    return FL.classify_route(_tree(spark, sf)).select("p_partkey", "path", "name", "route")


@query("skip_dirs", f"select p_partkey, path from {TREE} where type = 'blob' and not ({SKIPPED})")
def skip_dirs(spark, sf):
    return FL.filter_tree(_tree(spark, sf)).select("p_partkey", "path")


@query("ocr_files", f"select p_partkey, path from {TREE} where type = 'blob' and not ({SKIPPED}) and {ROUTE} = 'ocr'")
def ocr_files(spark, sf):
    return FL.files_by_route(_tree(spark, sf), "ocr").select("p_partkey", "path")


@query("files_per_repo", f"select repo, branch, p_partkey from (select *, row_number() over (partition by repo, branch order by path, p_partkey) as rn from (select *, {ROUTE} as route from {TREE} where type = 'blob' and not ({SKIPPED})) where route = 'text') where rn <= 5")
def files_per_repo(spark, sf):
    listed = FL.files_by_route(_tree(spark, sf), "text")
    return R.limit_per_group(listed, ["repo", "branch"], ["path", "p_partkey"], 5).select("repo", "branch", "p_partkey")


@query("first_lines_per_order_group", "select l_returnflag, l_orderkey, l_linenumber, cast(l_partkey as bigint) as l_partkey from (select *, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn <= 1500")
def first_lines_per_order_group(spark, sf):
    """First 1,500 per group of three large groups: the salted form of the group limit."""
    li = table(spark, sf, "lineitem")
    return R.limit_per_group(li, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 1500).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


@query("first_lines_of_large_groups", "select l_returnflag, count(*) as lines, max(l_orderkey) as last_order, cast(sum(l_orderkey * 8 + l_linenumber) as bigint) as digest from (select *, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn, count(*) over (partition by l_returnflag) as n from lineitem) where rn <= n // 2 or l_returnflag <> 'N' group by l_returnflag")
def first_lines_of_large_groups(spark, sf):
    """First half of one group, and the others, smaller than the number asked for, whole; cut by ranges, so no task orders a group."""
    li = table(spark, sf, "lineitem")
    half = li.filter(F.col("l_returnflag") == "N").count() // 2
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    first = R.first_by_range(li.filter(F.col("l_returnflag") == "N"), "l_returnflag", order, half)
    rest = R.first_by_range(li.filter(F.col("l_returnflag") != "N"), "l_returnflag", order, li.count())
    digest = F.sum(F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    return first.unionByName(rest).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.max("l_orderkey").alias("last_order"), digest.alias("digest"))


@query("source_urls", f"select p_partkey, concat('https://raw.githubusercontent.com/', repo, '/', branch, '/', path) as raw_url, concat('https://github.com/', repo, '/blob/', branch, '/', path) as source_url from {TREE}")
def source_urls(spark, sf):
    return FL.with_source_urls(_tree(spark, sf)).select("p_partkey", "raw_url", "source_url")


@query("resolve_branch", f"with T as (select * from {TREE} where repo <> 'repo3' or branch = 'master') select p_partkey, branch from T t where branch = case when exists (select 1 from T m where m.repo = t.repo and m.branch = 'main') then 'main' else 'master' end")
def resolve_branch(spark, sf):
    tree = _tree(spark, sf).filter((F.col("repo") != "repo3") | (F.col("branch") == "master"))
    return FL.resolve_branch(tree).select("p_partkey", "branch")


@query("latest_repos", "select s_nationkey as owner, s_suppkey, branch from (select s_nationkey, s_suppkey, case when s_suppkey % 4 = 0 then 'main' else 'dev' end as branch, row_number() over (partition by s_nationkey order by s_acctbal desc, s_name) as rn from supplier where s_suppkey % 5 <> 0) where rn <= 3")
def latest_repos(spark, sf):
    repos = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("owner"), "s_suppkey", F.col("s_name").alias("full_name"), F.when(F.col("s_suppkey") % 5 == 0, True).alias("private"),
        F.when(F.col("s_suppkey") % 4 != 0, "dev").alias("default_branch"), F.col("s_acctbal").alias("updated_at"))
    return FL.latest_repos(repos, 3).select("owner", "s_suppkey", F.col("default_branch").alias("branch"))


@query("size_policy", "select doc_id, 'paste' as kind, cast(least(octet_length(encode(text)), 3000) as int) as bytes from documents union all select doc_id, 'repo', cast(octet_length(encode(text)) as int) from documents where octet_length(encode(text)) <= 3000")
def size_policy(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    # a cut inside a character leaves one replacement character (3 bytes), so count what the cut kept
    whole = lambda c: F.octet_length(F.regexp_replace(c, "�", "")).cast("int")
    pastes = FL.apply_size_policy(docs, "paste", limit=3000)
    pastes = pastes.join(docs.select("doc_id", F.octet_length("content").alias("_n")), "doc_id").select(
        "doc_id", F.lit("paste").alias("kind"), F.when(F.col("_n") > 3000, F.lit(3000)).otherwise(whole(F.col("text"))).alias("bytes"))
    repo = FL.apply_size_policy(docs, "repo", limit=3000).select("doc_id", F.lit("repo").alias("kind"), F.octet_length("text").cast("int").alias("bytes"))
    return pastes.unionByName(repo)


# --- pastes ------------------------------------------------------------------------------------------------------

KEYED = "list_filter(list_transform(regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">[^<]*</a>', 1), lambda h: regexp_extract(h, '^/([A-Za-z0-9]{8})(?:\\?.*)?$', 1)), lambda k: k <> '')"


@query("paste_links", f"select page_id, paste_id, concat('https://pastebin.com/raw/', paste_id) as raw_url, paste_id as title, source from (select page_id, unnest(list_distinct({KEYED})) as paste_id, 'archive_scrape' as source from pages) where concat('/', paste_id) not in ('/archive', '/doc_api')")
def paste_links(spark, sf):
    return PA.paste_links(table(spark, sf, "pages")).select("page_id", "paste_id", "raw_url", "title", "source")


@query("paste_tables", "select page_id, paste_id, title, syntax from (select page_id, lpad(cast(page_id as varchar), 8, 'k') as paste_id, 'old' as title, case when page_id % 2 = 0 then 'text' else 'php' end as syntax from pages)")
def paste_tables(spark, sf):
    """Pages in the older layout: keys that appear twice, a header row, rows with and without a third cell."""
    key = F.lpad(F.col("page_id").cast("string"), 8, "k")
    cell = F.when(F.col("page_id") % 2 == 0, "").otherwise("<td>now</td><td>php</td>")
    row = F.concat(F.lit("<tr><td><a class='x' href='/"), key, F.lit("?source=a'>old</a></td>"), cell, F.lit("</tr>"))
    html = F.concat(F.lit("<p><a name='q'>no</a></p><table class=\"maintable\"><tr><th>n</th></tr>"), row, row, F.lit("</table>"))
    legacy = table(spark, sf, "pages").select("page_id", html.alias("html"))
    # the first layout would find these anchors too, so read the table on its own
    rows = legacy.select("page_id", F.explode(PA._first_of_each(PA._table(F.col("html")))).alias("r"))
    return rows.select("page_id", F.col("r.key").alias("paste_id"), F.col("r.title").alias("title"), F.col("r.syntax").alias("syntax"))


JSON_ROWS = "select conv_id, turn, case when turn % 3 = 0 then null else concat('k', conv_id, '_', turn) end as key, case when turn % 2 = 0 then concat('t', turn) end as title, length(text) as size from conversations"


@query("pastes_from_json", f"select conv_id, key as paste_id, coalesce(title, 'Untitled') as title, 'text' as syntax, cast(size as int) as size, 'scrape_api' as source from ({JSON_ROWS}), range(2) where key is not null")
def pastes_from_json(spark, sf):
    t = F.col("turn")
    item = F.struct(F.when(t % 3 != 0, F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))).alias("key"),
                    F.when(t % 2 == 0, F.concat(F.lit("t"), t.cast("string"))).alias("title"), F.length("text").cast("string").alias("size"))
    bodies = table(spark, sf, "conversations").select("conv_id", F.to_json(F.array(item, item)).alias("body"))
    return PA.pastes_from_json(bodies, 250).select("conv_id", "paste_id", "title", "syntax", "size", "source")


@query("first_nonempty", "select page_id from pages where page_id % 2 = 0")
def first_nonempty(spark, sf):
    pages = table(spark, sf, "pages").select("page_id")
    return PA.first_nonempty(pages.filter("page_id < 0"), pages.filter("page_id % 2 = 0"), pages)


# --- social ------------------------------------------------------------------------------------------------------

def _forum_json(spark, sf):
    """Conversations as landed profile bodies, one page per turn: user turns are posts, the other turns comments."""
    conv = table(spark, sf, "conversations")
    text = F.col("text")
    body = F.when(F.col("turn") % 5 == 3, "[deleted]").otherwise(text)
    child = F.struct(F.struct(F.concat(F.lit("p"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", text).alias("title"),
                              F.when(F.col("role") != "user", body).alias("body"), F.concat(F.lit("/r/"), F.col("turn").cast("string")).alias("permalink")).alias("data"))
    user = F.concat(F.lit("u/user"), F.col("conv_id").cast("string")).alias("username")
    page = F.col("turn").alias("page")
    kind = F.when(F.col("role") == "user", "submitted").otherwise("comments").alias("kind")
    listings = conv.select(user, kind, page, F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))).alias("body"))
    about_body = F.to_json(F.struct(F.struct(F.struct(
        F.when(F.col("conv_id") % 2 == 0, " hello ").otherwise("").alias("public_description"), F.concat(F.lit("u_"), F.col("conv_id").cast("string")).alias("display_name_prefixed")
    ).alias("subreddit")).alias("data")))
    about = conv.select(user, F.lit("about").alias("kind"), page, about_body.alias("body"))
    return about.unionByName(listings)


FORUM = """with P as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'user'),
PP as (select * from P where rn <= 3 and trim(text) <> ''),
Q as (select conv_id, turn, case when turn % 5 = 3 then '[deleted]' else text end as body, row_number() over (partition by conv_id order by turn) as rn from conversations where role <> 'user'),
U as (select conv_id, 1 + count(pp.turn) as used from (select distinct conv_id from conversations) c left join PP pp using (conv_id) group by conv_id)
select concat('user', conv_id) as username, 0 as part, concat('user', conv_id, '_bio') as post_id, 'bio' as content_type, md5(concat(case when conv_id % 2 = 0 then 'hello | ' else '' end, 'u_', conv_id)) as digest from U
union all select concat('user', conv_id), 1, concat('p', turn), 'post', md5(trim(text)) from PP
union all select concat('user', conv_id), 2, concat('p', turn), 'post', md5(trim(body)) from Q join U using (conv_id) where rn <= greatest(3 - used, 0) and body <> '[deleted]'"""


@query("forum_documents", FORUM)
def forum_documents(spark, sf):
    out = SO.forum_documents(_forum_json(spark, sf), 3)
    return out.select("username", "part", "post_id", "content_type", F.md5("content").alias("digest"))


@query("microblog_documents", """select concat('u', c_custkey) as username, concat('u', c_custkey, '_bio') as post_id, c_mktsegment as content from customer where c_custkey % 2 = 0
 union all select concat('u', c_custkey), concat('u', c_custkey, '_profile_meta'), concat(c_name, ' | N', c_nationkey) from customer
 union all select concat('u', o_custkey), post_id, o_orderpriority from (select o_custkey, case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else concat('tweet_', o_orderkey) end as post_id, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn <= 2""")
def microblog_documents(spark, sf):
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("@u"), F.col(c).cast("string")).alias("username")
    profile = table(spark, sf, "customer").select(
        name("c_custkey"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("bio"), F.col("c_name").alias("name"),
        F.concat(F.lit(" N"), F.col("c_nationkey").cast("string")).alias("location"), F.lit(None).cast("string").alias("website"))
    href = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/x/status/"), F.col("o_orderkey").cast("string"), F.lit("/")))
    posts = table(spark, sf, "orders").select(name("o_custkey"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("text"), href.alias("href"))
    return SO.social_documents(" Twitter ", profile, posts, n=2).select("username", "post_id", "content")


@query("professional_documents", """select concat('u', c_custkey) as username, concat('u', c_custkey, '_bio') as post_id, concat_ws(' | ', c_name, case when c_custkey % 2 = 0 then c_mktsegment end) as content from customer
 union all select concat('u', o_custkey), concat('u', o_custkey, '_exp_', o_orderkey), repeat(o_orderpriority, 3) from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn <= 2 and length(repeat(o_orderpriority, 3)) > 20
 union all select concat('u', o_custkey), concat('u', o_custkey, '_activity_', o_orderkey), repeat(o_orderpriority, 2) from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn <= 4 and length(repeat(o_orderpriority, 2)) > 20""")
def professional_documents(spark, sf):
    k = F.col("c_custkey")
    profile = table(spark, sf, "customer").select(
        F.concat(F.lit("https://www.linkedin.com/in/u"), k.cast("string"), F.lit("/")).alias("username"), F.col("c_name").alias("name_1"), F.lit("other").alias("name_2"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("headline_1"), F.lit(None).cast("string").alias("about_1"))
    rows = lambda n: table(spark, sf, "orders").select(F.concat(F.lit("/u"), F.col("o_custkey").cast("string")).alias("username"), F.col("o_orderkey").alias("position"), F.repeat("o_orderpriority", n).alias("text"))
    return SO.social_documents("linkedin", profile, rows(3), rows(2), n=4).select("username", "post_id", "content")


def _messages(spark, sf):
    return table(spark, sf, "conversations").select(F.concat(F.lit("@c"), (F.col("conv_id") % 20).cast("string")).alias("channel"),
                                                    (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.when(F.col("turn") % 4 != 1, F.col("text")).alias("content"))


MESSAGES = "(select concat('c', conv_id % 20) as channel, conv_id * 100 + turn as message_id, case when turn % 4 <> 1 then text end as content from conversations)"


@query("channel_messages", f"select channel, message_id, concat('https://t.me/', channel, '/', message_id) as url, 'message' as content_type from (select *, row_number() over (partition by channel order by message_id desc) as rn from {MESSAGES}) where rn <= 10 and content <> ''")
def channel_messages(spark, sf):
    return CH.channel_documents(_messages(spark, sf), 10).select("channel", "message_id", "url", "content_type")


@query("messages_per_channel", f"select channel, count(*) as messages, min(message_id) as first_id, max(message_id) as last_id from {MESSAGES} where content <> '' group by channel")
def messages_per_channel(spark, sf):
    return CH.messages_per_channel(CH.channel_documents(_messages(spark, sf)))


@query("ocr_documents", f"select doc_id, concat('img', doc_id, '_ocr') as source_url, case when doc_id % 3 = 0 then 'true' else 'false' end as is_kyc, md5(case when doc_id % 3 = 0 then concat({O.q(dims.KYC_MARKER_LINE)}, chr(10), 'Election Commission ', text) else text end) as digest, true as is_ocr_derived from documents")
def ocr_documents(spark, sf):
    k = F.col("doc_id")
    texts = table(spark, sf, "documents").select(
        F.concat(F.lit("img"), k.cast("string")).alias("source_url"), F.lit("r").alias("repo_id"), k.cast("string").alias("file_path"),
        F.when(k % 3 == 0, F.concat(F.lit("Election Commission "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    out = CH.ocr_documents(texts)
    return out.select(F.col("file_path").cast("bigint").alias("doc_id"), "source_url", F.col("metadata.is_kyc").alias("is_kyc"), F.md5("text").alias("digest"), "is_ocr_derived")


@query("image_documents", "select doc_id, concat('p', doc_id, '_img') as post_id, 'image_ocr' as content_type from documents where doc_id % 3 <> 0")
def image_documents(spark, sf):
    k = F.col("doc_id")
    posts = table(spark, sf, "documents").select(
        "doc_id", F.lit("reddit").alias("platform"), F.lit("u").alias("username"), F.concat(F.lit("p"), k.cast("string")).alias("post_id"),
        F.when(k % 3 == 1, "http://x/A.JPG").when(k % 3 == 2, "http://x/b.webp").otherwise("http://x/jpg").alias("url"), F.col("text").alias("ocr_text"))
    return SO.image_documents(posts).select(F.regexp_extract("post_id", "p([0-9]+)", 1).cast("bigint").alias("doc_id"), "post_id", "content_type")


# --- pipelines ---------------------------------------------------------------------------------------------------

CORPUS_FILES = "RF as (select doc_id, container as repo, concat('src/f', doc_id, '.py') as path from D)"
CHOSEN = "CHS as (select repo, path, doc_id from RF)"


def _repo_tables(spark, sf):
    docs = corpus(spark, sf).select(F.col("container").alias("repo"), F.lit("main").alias("branch"), F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    files = docs.select("repo", "branch", "path", F.lit("blob").alias("type"), F.length("text").cast("long").alias("size"))
    return files, docs


REPO_F = f"RFF as (select repo as scan_id, path as source_key, type, conf, 'github_public' as st from F join (select repo, path as p2, doc_id from CHS) using (doc_id)), {O.ess_ctes('RFF', ['scan_id', 'source_key'], 'st')}"
REPO_F = REPO_F.replace("path as source_key, type", "p2 as source_key, type")


@query("scan_repo", O.with_(f"{O.F}, {CORPUS_FILES}, {CHOSEN}, {REPO_F}", O.summary_select("E", ["scan_id"])))
def scan_repo(spark, sf):
    return P.scan_repo(*_repo_tables(spark, sf)).summary.withColumn("all_types", joined("all_types"))


@query("scan_repo_findings", O.with_(f"{O.F}, {CORPUS_FILES}, {CHOSEN}", "select concat('GitHub: ', repo, '/', c.path) as source, concat('https://github.com/', repo, '/blob/main/', c.path) as source_url, type, value_masked from F join (select repo, path, doc_id from CHS) c using (doc_id)"))
def scan_repo_findings(spark, sf):
    return P.scan_repo(*_repo_tables(spark, sf)).findings.select("source", "source_url", "type", "value_masked")


def _repos(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select((n % 5).cast("string").alias("owner"), F.concat(F.lit("repo"), n.cast("string")).alias("full_name"),
                                             F.lit("main").alias("default_branch"), F.lit(False).alias("private"), n.alias("updated_at"))


@query("scan_user_repos", O.with_(f"{O.F}, {CORPUS_FILES}, {CHOSEN}, OW as (select *, cast(cast(substr(repo, 5) as int) % 5 as varchar) as owner from CHS), "
       f"UF as (select owner as scan_id, repo as source_key, type, conf, 'github_public' as st from F join (select owner, repo, doc_id from OW) using (doc_id)), {O.ess_ctes('UF', ['scan_id', 'source_key'], 'st')}",
       O.summary_select("E", ["scan_id"])))
def scan_user_repos(spark, sf):
    files, contents = _repo_tables(spark, sf)
    return P.scan_user_repos(_repos(spark, sf), files, contents).summary.withColumn("all_types", joined("all_types"))


def _paste_tables(spark, sf):
    docs = corpus(spark, sf).select(F.concat(F.lit("P"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("paste_id"), "text")
    listing = docs.select("paste_id", F.concat(F.lit("https://pastebin.com/"), "paste_id").alias("url"), F.lit("").alias("raw_url"), F.lit("t").alias("title"),
                          F.lit("text").alias("syntax"), F.lit(0).alias("size"), F.lit("0").alias("expire"), F.lit("scrape_api").alias("source"))
    return listing, docs


PASTE_F = f"PF as (select 'pastes' as scan_id, doc_id as source_key, type, conf, 'pastebin' as st from F), {O.ess_ctes('PF', ['scan_id', 'source_key'], 'st', out='PE')}"


@query("scan_pastes", O.with_(f"{O.F}, {PASTE_F}", O.summary_select("PE", ["scan_id"])))
def scan_pastes(spark, sf):
    return P.scan_pastes(*_paste_tables(spark, sf)).summary.withColumn("all_types", joined("all_types"))


@query("scan_combined", O.with_(f"{O.F}, RFF as (select 'combined' as scan_id, doc_id as source_key, type, conf, 'github_public' as st from F), {O.ess_ctes('RFF', ['scan_id', 'source_key'], 'st')}, {PASTE_F}, "
       f"A as ({O.summary_select('E', ['scan_id'])}), B as ({O.summary_select('PE', ['scan_id'])})",
       """select greatest(a.max_ess, b.max_ess) as max_ess, (cast(a.avg_ess * 100 as bigint) + cast(b.avg_ess * 100 as bigint)) / 200.0 as avg_ess, case when a.max_ess >= b.max_ess then a.label else b.label end as label,
 a.total_sources + b.total_sources as total_sources, array_to_string(list_sort(list_distinct(list_concat(string_split(a.all_types, ','), string_split(b.all_types, ',')))), ',') as all_types from A a, B b"""))
def scan_combined(spark, sf):
    files, contents = _repo_tables(spark, sf)
    one_repo = files.withColumn("repo", F.lit("all")), contents.withColumn("repo", F.lit("all"))
    out = P.scan_combined(P.scan_repo(*one_repo), P.scan_pastes(*_paste_tables(spark, sf))).summary
    return out.select("max_ess", "avg_ess", "label", "total_sources", joined("all_types").alias("all_types"))


def _leak_messages(spark, sf):
    return corpus(spark, sf).select(F.col("container").alias("channel"), F.col("doc_id").alias("message_id"), F.col("text").alias("content"))


CHAN_F = f"CM as (select doc_id, container from D), TF as (select 'social' as scan_id, concat('channel/', c.container) as source_key, type, conf, 'telegram' as st from F join CM c using (doc_id)), {O.ess_ctes('TF', ['scan_id', 'source_key'], 'st')}"


@query("scan_social", O.with_(f"{O.F}, {CHAN_F}", f"select source_key, {O.ESS_COLUMNS} from E"))
def scan_social(spark, sf):
    out = P.scan_social(_forum_json(spark, sf), _leak_messages(spark, sf)).ess
    return out.select("source_key", "score", "base_score", "toxic_combo_label", "toxic_multiplier", "exposure_multiplier", "confidence_penalty",
                      joined("types_found").alias("types_found"), "ess_label", "findings_count")


@query("scan_profiles", 
       "select concat('user', c_custkey) as scan_id, cast(1 as bigint) as total_findings, cast(2.48 as double) as max_ess, 'INFO' as label from customer")
def scan_profiles(spark, sf):
    """Every customer has a mail entry and a channel entry without landed messages."""
    who = F.concat(F.lit("user"), F.col("c_custkey").cast("string"))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("label"), value.alias("value"))
    profiles = spread(table(spark, sf, "customer").select("c_custkey")).select(who.alias("user_email"), F.array(entry("Email", F.concat(F.lit(" u"), F.col("c_custkey").cast("string"), F.lit("@m.io "))), entry("telegram", F.lit("@none"))).alias("entries"))
    files, contents = _repo_tables(spark, sf)
    out = P.scan_profiles(profiles, _repos(spark, sf), files, contents, _forum_json(spark, sf), _leak_messages(spark, sf)).stored()
    counts = out.findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_findings"))
    return out.summary.join(counts, "scan_id").select("scan_id", "total_findings", "max_ess", "label")


@query("scan_profile_routes", O.with_(f"{O.F}, {CORPUS_FILES}, CH2 as (select * from RF), "
       "CM as (select doc_id, container from D)",
       "select concat('user', r_regionkey) as scan_id, 'github' as platform, count(*) as findings from region, F join CH2 using (doc_id) where cast(substr(repo, 5) as int) % 5 = r_regionkey group by all "
       "union all select concat('user', r_regionkey), 'telegram', count(*) from region, F join CM c using (doc_id) where c.container = concat('repo', r_regionkey) group by all"))
def scan_profile_routes(spark, sf):
    key = F.col("r_regionkey").cast("string")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit("main").alias("label"), value.alias("value"))
    profiles = table(spark, sf, "region").select(F.concat(F.lit("user"), key).alias("user_email"), F.array(
        entry("github", F.concat(F.lit("https://github.com/"), key, F.lit("/"))), entry("telegram", F.concat(F.lit("@repo"), key))).alias("entries"))
    files, contents = _repo_tables(spark, sf)
    out = P.scan_profiles(profiles, _repos(spark, sf), files, contents, _forum_json(spark, sf), _leak_messages(spark, sf))
    return out.findings.groupBy("scan_id", "platform").agg(F.count(F.lit(1)).alias("findings"))


@query("history_rows", O.with_(f"{O.F}, {CORPUS_FILES}, {CHOSEN}, {REPO_F}, SMM as ({O.summary_select('E', ['scan_id'])})",
       "select 'github' as scan_type, c.repo as target, cast(coalesce(f.n, 0) as int) as findings_count, coalesce(max_ess, 0.0) as max_ess, coalesce(label, 'INFO') as ess_label, cast(c.n as int) as sources_scanned from (select repo, count(*) as n from CHS group by repo) c left join (select scan_id, count(*) as n from RFF group by scan_id) f on f.scan_id = c.repo left join SMM on SMM.scan_id = c.repo"))
def history_rows(spark, sf):
    return P.history_rows(P.scan_repo(*_repo_tables(spark, sf)).stored(), "github").drop("scan_duration")


# --- history and profiles ----------------------------------------------------------------------------------------


def _history(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_email"), F.col("o_orderstatus").alias("scan_type"),
        (F.col("o_orderkey") % 50).cast("int").alias("findings_count"), ((F.col("o_orderkey") % 1001).cast("double") / 100).alias("max_ess"),
        (F.col("o_orderkey") % 7).cast("int").alias("sources_scanned"), F.col("o_orderdate").alias("created_at"))


HIST = "(select o_orderkey as id, concat('u', o_custkey) as user_email, o_orderstatus as scan_type, cast(o_orderkey % 50 as int) as findings_count, cast(o_orderkey % 1001 as double) / 100 as max_ess, cast(o_orderkey % 7 as int) as sources_scanned, o_orderdate as created_at from orders)"


@query("user_dashboard", f"select user_email, count(*) as total_scans, cast(sum(findings_count) as bigint) as total_findings, max(max_ess) as max_ess, cast(sum(sources_scanned) as bigint) as sources_scanned from {HIST} group by user_email")
def user_dashboard(spark, sf):
    return H.user_dashboard(_history(spark, sf))


@query("history_top100", f"select user_email, id from (select *, row_number() over (partition by user_email order by created_at desc, id desc) as rn from {HIST}) where rn <= 100")
def history_top100(spark, sf):
    return H.newest_per_user(_history(spark, sf)).select("user_email", "id")


@query("user_history", f"select id, created_at from {HIST} where user_email = 'u7' order by created_at desc, id desc limit 100")
def user_history(spark, sf):
    return H.user_history(_history(spark, sf), "u7").select("id", "created_at")


@query("recent_scans", f"select user_email, id from (select *, row_number() over (partition by user_email order by created_at desc, id desc) as rn from {HIST}) where rn <= 5")
def recent_scans(spark, sf):
    return H.recent_scans(_history(spark, sf)).select("user_email", "id")


@query("history_delete", f"select id from {HIST} h where not exists (select 1 from orders o where o.o_orderkey = h.id and o.o_orderkey % 3 = 0 and h.user_email = concat('u', o.o_custkey - o.o_orderkey % 2))")
def history_delete(spark, sf):
    """Every third row is asked to go; half of the requests name a user who does not own the row."""
    ask = table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0).select(
        F.concat(F.lit("u"), (F.col("o_custkey") - F.col("o_orderkey") % 2).cast("string")).alias("user_email"), F.col("o_orderkey").alias("id"))
    return H.delete_history_rows(_history(spark, sf), ask).select("id")


@query("history_missing", "select o_orderkey as id from orders where o_orderkey % 3 = 0 and o_orderkey % 2 = 1")
def history_missing(spark, sf):
    ask = table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0).select(
        F.concat(F.lit("u"), (F.col("o_custkey") - F.col("o_orderkey") % 2).cast("string")).alias("user_email"), F.col("o_orderkey").alias("id"))
    return H.missing_deletions(_history(spark, sf), ask).select("id")


@query("profile_latest", "select concat('u', o_custkey) as user_email, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as notes from orders group by o_custkey")
def profile_latest(spark, sf):
    log = table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_email"), F.col("o_orderpriority").alias("notes"),
                                            F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    return H.latest_profiles(log).select("user_email", "notes")


@query("last_scan", "select concat('u', o_custkey) as user_email, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as total_findings from orders group by o_custkey")
def last_scan(spark, sf):
    log = table(spark, sf, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_email"), F.col("o_orderkey").alias("total_findings"),
                                            F.struct("o_orderdate", "o_orderkey").alias("scanned_at"))
    return H.last_scan(log).select("user_email", "total_findings")


@query("session_totals", """with L as (select l_orderkey % 50 as session_id, l_returnflag as platform from lineitem), PL as (select o_orderkey % 50 as session_id, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as platform from orders)
select session_id, platform, cast(sum(f) as bigint) as total_files, cast(sum(g) as bigint) as total_findings from (select session_id, platform, 1 as f, 0 as g from PL union all select session_id, platform, 0, 1 from L) group by rollup (session_id, platform) having session_id is not null""")
def session_totals(spark, sf):
    leaks = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("session_id"), F.col("l_returnflag").alias("platform"))
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    platforms = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("session_id"), status.alias("platform"), F.lit(1).alias("file_count"))
    return R.session_totals(leaks, platforms)


@query("leak_records", O.with_(f"{O.F},\n{O.MASKED}", f"""select doc_id, type as entity_type, value_masked, snippet, sha256(concat({O.CANON}, '|', case when type = 'PHONE' and length(n) = 12 and n like '91%' then substr(n, 3) else n end)) as identity_cluster_id
 from (select *, lower(case when type = 'PHONE' then regexp_replace(value, '[^0-9]', '', 'g') else regexp_replace(value, '[\\s\\-]', '', 'g') end) as n from FM)"""))
def leak_records(spark, sf):
    from leakscope.plans.registry import corpus_findings

    return SK.leak_records(corpus_findings(spark, sf, masked=True)).select("doc_id", "entity_type", "value_masked", "snippet", "identity_cluster_id")


# --- alerts over events ------------------------------------------------------------------------------------------

RISKY = "case event_type when 'error' then 'Critical' when 'signup' then 'High' when 'purchase' then 'Medium' else 'Low' end"


def _alerts(spark, sf):
    e = F.col("event_type")
    risk = F.when(e == "error", "Critical").when(e == "signup", "High").when(e == "purchase", "Medium").otherwise("Low")
    return table(spark, sf, "events").select(e.alias("type"), F.col("user_id").cast("string").alias("value"), risk.alias("risk"), F.col("ts").alias("detected_at"), "event_id")


COUNTS = "count(*) as total, count(*) filter (where r = 'Critical') as critical, count(*) filter (where r = 'High') as high, count(*) filter (where r = 'Medium') as medium"


@query("alert_windows", f"select time_bucket(interval '300 seconds', ts, timestamp '1970-01-01') as window_start, time_bucket(interval '300 seconds', ts, timestamp '1970-01-01') + interval '300 seconds' as window_end, {COUNTS} from (select *, {RISKY} as r from events) group by 1, 2")
def alert_windows(spark, sf):
    return A.alert_windows(_alerts(spark, sf))


@query("alert_sliding_windows", f"select w as window_start, w + interval '1 hour' as window_end, {COUNTS} from (select *, {RISKY} as r, unnest([time_bucket(interval '15 minutes', ts, timestamp '1970-01-01') - to_minutes(cast(15 * i as int)) for i in range(4)]) as w from events) group by 1, 2")
def alert_sliding_windows(spark, sf):
    return A.alert_windows(_alerts(spark, sf), "1 hour", "15 minutes")


@query("alert_dedupe", "select event_type as type, cast(user_id as varchar) as value, min(ts) as detected_at from events group by event_type, user_id")
def alert_dedupe(spark, sf):
    return R.first_per_value(_alerts(spark, sf), ["detected_at", "event_id"]).select("type", "value", "detected_at")


@query("alert_sessions", """select user_id, min(ts) as session_start, max(ts) as last_event, count(*) as events from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from (
 select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '30 minutes' then 0 else 1 end as fresh from events)) group by user_id, run""")
def alert_sessions(spark, sf):
    return A.alert_sessions(table(spark, sf, "events"), ["user_id"], "ts", 1800)


@query("alert_batch", O.with_(O.F, "select 'alert_batch' as type, count(*) as total, count(*) filter (where risk = 'Critical') as critical, count(*) filter (where risk = 'High') as high, count(*) filter (where risk = 'Medium') as medium, 10 as sample_size, 'Critical' as worst from F"))
def alert_batch(spark, sf):
    from leakscope.plans.registry import corpus_findings

    found = corpus_findings(spark, sf, fields=("type", "value_masked", "risk", "confidence")).withColumns({"source": F.col("container"), "detected_at": F.lit("2024-01-01").cast("timestamp")})
    return A.alert_batch(found).select("type", "total", "critical", "high", "medium", "sample_size", F.get("findings", F.lit(0))["risk"].alias("worst"))


def _landed(spark, sf):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "github").when(k % 3 == 1, "telegram").otherwise("pastebin")
    return corpus(spark, sf).select(kind.alias("kind"), F.col("container").alias("target"), "path", F.col("source_url").alias("url"),
                                    F.when(k % 50 != 7, F.col("text")).alias("text"), F.timestamp_seconds(F.lit(1704067200) + k * 60).alias("landed_at"), "doc_id")


TARGETED = "(case doc_id % 3 when 0 then container = 'repo1' when 1 then container in ('repo2', 'repo3') else true end) and doc_id % 50 <> 7"


@query("alert_targets", O.with_(O.F, f"select concat(case doc_id % 3 when 0 then 'github' when 1 then 'telegram' else 'pastebin' end, ':', container) as source, type, value from F where {TARGETED}"))
def alert_targets(spark, sf):
    """The batch form of the alert scan: configured targets only, tagged with source and time."""
    docs = A.for_targets(A.readable(_landed(spark, sf)), A.targets_table(spark, ["repo1"], True, ["repo2", "repo3"]))
    return A.tagged_findings(docs, "fast").select("source", "type", "value")


@query("alert_errors", O.with_(f"{O.C}, {O.D}", "select 'error' as type, case doc_id % 3 when 0 then 'github' when 1 then 'telegram' else 'pastebin' end as kind, container as target, path, 'Scan failed: no content' as message from D where doc_id % 50 = 7"))
def alert_errors(spark, sf):
    return A.unreadable(_landed(spark, sf))


def _run_stream(frame, name, mode="append"):
    """Runs a stream over what is there and reads its files from the shared folder, which is new for every run."""
    spark, run = frame.sparkSession, f"{name}-{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{run}"
    q = (frame.writeStream.format("parquet").queryName(run).outputMode(mode).option("path", f"{folder}/rows")
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


@query("stream_findings", O.with_(O.F, "select doc_id, type, value, cast(conf as double) as confidence from F"))
def stream_findings(spark, sf):
    """The scan as a streaming query over the customer files: the same rows as the batch."""
    schema = table(spark, sf, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    from leakscope.operators.detect import scan
    from leakscope.sources.corpus import corpus_documents

    out = scan(corpus_documents(stream)).select("doc_id", "type", "value", dbl("confidence").alias("confidence"))
    return _run_stream(out, "stream_findings")
