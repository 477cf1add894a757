"""Paste listings from landed API bodies or landed archive pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import literal_array, strip

API_LIMIT = 250
COLUMNS = ["paste_id", "url", "raw_url", "title", "syntax", "size", "expire", "source"]
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</a\s*>"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _paste(key: Column, title: Column, syntax: Column, size: Column, expire: Column, source: str) -> list[Column]:
    return [
        key.alias("paste_id"), F.concat(F.lit(dims.PASTE_HOST + "/"), key).alias("url"),
        F.concat(F.lit(dims.PASTE_HOST + "/raw/"), key).alias("raw_url"), title.alias("title"), syntax.alias("syntax"),
        size.cast("int").alias("size"), expire.alias("expire"), F.lit(source).alias("source"),
    ]


def pastes_from_json(raw: DataFrame, n: int | None = None, body: str = "body") -> DataFrame:
    """Landed API bodies (a JSON array each) -> pastes: the items of a body (with n, the first ones) that have a key."""
    item = "array<struct<key:string,title:string,syntax:string,size:string,expire:string>>"
    items = F.from_json(F.col(body), item)
    items = items if n is None else F.slice(items, 1, n)
    keep = [c for c in raw.columns if c != body]
    rows = raw.select(*keep, F.posexplode_outer(items).alias("position", "_i")).filter(F.length("_i.key") > 0)
    return rows.select(
        *keep, "position",
        *_paste(F.col("_i.key"), F.coalesce("_i.title", F.lit("Untitled")), F.coalesce("_i.syntax", F.lit("text")),
                F.coalesce(F.expr("try_cast(_i.size as int)"), F.lit(0)), F.coalesce("_i.expire", F.lit("0")), "scrape_api"),
    )


def _href(anchor: Column) -> Column:
    return F.concat(F.regexp_extract(anchor, HREF, 1), F.regexp_extract(anchor, HREF, 2))


def visible_text(html: Column) -> Column:
    """Text of a fragment: tags out, basic entities decoded, trimmed."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(bare)


def _first_of_each(links: Column) -> Column:
    keys = F.transform(links, lambda x: x["key"])
    return F.filter(links, lambda x, i: F.array_position(keys, x["key"]) == i + 1)


def _modern(html: Column) -> Column:
    """Anchors whose address is a paste key and not navigation."""
    found = F.transform(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(_href(a).alias("href"), visible_text(a).alias("label")),
    )
    wanted = F.filter(
        found,
        lambda x: x["href"].rlike(dims.PASTE_KEY)
        & ~F.array_contains(literal_array(dims.PASTE_NAV_PATHS), F.substring_index(x["href"], "?", 1)),
    )
    return F.transform(
        wanted,
        lambda x: F.struct(
            F.regexp_extract(x["href"], dims.PASTE_KEY, 1).alias("key"),
            F.when(F.length(x["label"]) > 0, x["label"]).otherwise("Untitled").alias("title"), F.lit("text").alias("syntax"),
        ),
    )


def _table(html: Column) -> Column:
    """Rows of the older table: key and title from the first cell, syntax from the third."""
    body = F.regexp_extract(html, r"""(?is)<table\b[^>]*\bmaintable\b[^>]*>(.*?)</table\s*>""", 1)
    rows = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)),
        lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1)),
    )
    linked = F.transform(
        F.filter(rows, lambda c: F.size(c) > 0),
        lambda c: F.struct(
            F.regexp_extract(_href(F.get(c, F.lit(0))), dims.PASTE_KEY, 1).alias("key"),
            visible_text(F.get(c, F.lit(0))).alias("title"),
            F.coalesce(visible_text(F.get(c, F.lit(2))), F.lit("text")).alias("syntax"),
        ),
    )
    return F.filter(linked, lambda x: F.length(x["key"]) > 0)


def paste_links(pages: DataFrame, n: int | None = None, page_key: str = "page_id", html: str = "html") -> DataFrame:
    """Pastes linked from archive pages, first occurrence of a key per page; with n, the first n per page.

    All of it happens inside the row of the page: no shuffle, no join with the navigation list.
    """
    some = lambda links: links if n is None else F.slice(links, 1, n)
    modern, older = some(_first_of_each(_modern(F.col(html)))), some(_first_of_each(_table(F.col(html))))
    staged = pages.select(page_key, html, F.explode_outer(F.array(modern)).alias("_m"))
    links = F.when(F.size("_m") > 0, F.col("_m")).otherwise(older)
    rows = staged.select(page_key, F.posexplode_outer(links).alias("position", "_l")).filter(F.col("_l").isNotNull())
    return rows.select(
        page_key, "position",
        *_paste(F.col("_l.key"), F.col("_l.title"), F.col("_l.syntax"), F.lit(0), F.lit("N/A"), "archive_scrape"),
    )


def demo_pastes(spark: SparkSession) -> DataFrame:
    keys = spark.range(1).select(F.posexplode(literal_array(dims.DEMO_PASTE_IDS)).alias("position", "_k"))
    return keys.select(
        "position", *_paste(F.col("_k"), F.lit("Demo Paste"), F.lit("text"), F.lit(0), F.lit("N/A"), "demo_list")
    )


def first_nonempty(*frames: DataFrame) -> DataFrame:
    """The first frame that has any row, the last one when none has.

    Each test is a one-row job that stops at the first row; the chosen frame is returned as it is, with no join around it.
    """
    for frame in frames[:-1]:
        if not frame.isEmpty():
            return frame
    return frames[-1]


def recent_pastes(api: DataFrame, archive: DataFrame, demo: DataFrame, n: int | None = None) -> DataFrame:
    """API listing, else archive, else the fixed list; with n, the first ones by position."""
    found = first_nonempty(api, archive, demo)
    return found if n is None else found.orderBy("position", "paste_id").limit(n)
