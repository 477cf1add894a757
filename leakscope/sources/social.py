"""Profiles, posts and comments as documents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import join_non_blank, normalise_handle, strip
from leakscope.operators.rollups import limit_per_group, union_findings

ITEM = ["platform", "username", "post_id", "content", "url", "content_type"]
LISTING = "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,body:string,permalink:string>>>>>"
ABOUT = "struct<data:struct<subreddit:struct<public_description:string,display_name_prefixed:string>>>"


def _item(platform: str, user: Column, post_id: Column, content: Column, url: Column, kind: str) -> list[Column]:
    return [
        F.lit(platform).alias("platform"), user.alias("username"), post_id.alias("post_id"), content.alias("content"),
        url.alias("url"), F.lit(kind).alias("content_type"),
    ]


def _children(bodies: DataFrame) -> DataFrame:
    """Landed listing bodies -> (username, page, position, item). A long listing may come as many pages."""
    items = F.from_json(F.col("body"), LISTING)["data"]["children"]
    return bodies.select("username", "page", F.posexplode_outer(items).alias("position", "_c")).filter(
        F.col("_c").isNotNull()
    ).select("username", "page", "position", "_c.data.*")


def forum_documents(forum_json: DataFrame, max_posts: int | None = None, budget: str = "clamp") -> DataFrame:
    """Landed JSON (username, kind, body, optional page) -> bio, post and comment documents: all of a user's.

    With `max_posts`, posts are the first `max_posts` of a user. Comments may use what bio and posts left of `max_posts`. When those
    already exceed it, `clamp` gives no comments; `as_is` keeps all but the last few, as a slice with a negative end does.
    """
    if budget not in ("clamp", "as_is"):
        raise ValueError("budget must be 'clamp' or 'as_is'")
    page_no = F.col("page") if "page" in forum_json.columns else F.lit(0)
    raw = forum_json.withColumns({"username": normalise_handle(F.col("username"), "forum"), "page": page_no})
    about = raw.filter(F.col("kind") == "about")
    info = F.from_json(F.col("body"), ABOUT)["data"]["subreddit"]
    user = F.col("username")
    page = F.concat(F.lit("https://reddit.com/user/"), user)
    order = ["page", "position"]
    # one profile per user: the first landed one
    profile = about.groupBy("username").agg(
        F.min_by(join_non_blank(" | ", info["public_description"], info["display_name_prefixed"]), F.col("page")).alias("_t"))
    bio = profile.filter(F.length("_t") > 0).select(
        F.lit(0).alias("part"), F.lit(0).alias("page"), F.lit(0).alias("position"),
        *_item("reddit", user, F.concat(user, F.lit("_bio")), F.col("_t"), page, "bio"),
    )
    link = F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit("")))
    submitted = limit_per_group(_children(raw.filter(F.col("kind") == "submitted")), "username", order, max_posts)
    text = strip(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit(""))))
    posts = submitted.withColumn("_t", text).filter(F.length("_t") > 0).select(
        F.lit(1).alias("part"), *order, *_item("reddit", user, F.coalesce("id", F.lit("unknown")), F.col("_t"), link, "post"))
    emitted = bio.unionByName(posts).groupBy("username").agg(F.count(F.lit(1)).cast("int").alias("_used"))
    # a user's comments are first cut to max_posts (cheap on both sides of the shuffle), then to the user's budget
    talk = limit_per_group(_children(raw.filter(F.col("kind") == "comments")), "username", order, max_posts)
    mine = Window.partitionBy("username")
    comments = talk
    if max_posts is not None:
        ranked = talk.withColumns({"_rn": F.row_number().over(mine.orderBy(*order)), "_n": F.count(F.lit(1)).over(mine)})
        left = F.lit(max_posts) - F.coalesce("_used", F.lit(0))
        over = F.greatest(F.col("_n") + left, F.lit(0)) if budget == "as_is" else F.lit(0)
        comments = ranked.join(emitted, "username", "left").filter(F.col("_rn") <= F.when(left >= 0, left).otherwise(over))
    comments = comments.withColumn("_t", strip(F.coalesce("body", F.lit("")))).filter(
        (F.length("_t") > 0) & ~F.col("_t").isin(dims.REMOVED_BODIES)
    ).select(F.lit(2).alias("part"), *order, *_item("reddit", user, F.coalesce("id", F.lit("unknown")), F.col("_t"), link, "post"))
    # a user whose profile could not be fetched yields nothing at all
    every = bio.unionByName(posts).unionByName(comments)
    return every.join(profile.select("username"), "username", "left_semi").select("part", *order, *ITEM)


def microblog_documents(profile: DataFrame, posts: DataFrame, n: int | None = None) -> DataFrame:
    """profile(username, bio, name, location, website), posts(username, position, text, href) -> documents."""
    prof = profile.withColumn("username", normalise_handle(F.col("username"), "twitter"))
    user = F.col("username")
    page = F.concat(F.lit("https://twitter.com/"), user)
    bio = prof.withColumn("_t", strip(F.coalesce("bio", F.lit("")))).filter(F.length("_t") > 0).select(
        *_item("twitter", user, F.concat(user, F.lit("_bio")), F.col("_t"), page, "bio"))
    meta = prof.withColumn("_t", join_non_blank(" | ", F.col("name"), F.col("location"), F.col("website"))).filter(
        F.length("_t") > 0
    ).select(*_item("twitter", user, F.concat(user, F.lit("_profile_meta")), F.col("_t"), page, "bio"))
    cut = limit_per_group(posts.withColumn("username", normalise_handle(F.col("username"), "twitter")), "username", ["position"], n)
    href = F.col("href")
    post_id = F.when(F.length(href) > 0, F.element_at(F.split(F.regexp_replace(href, r"/+$", ""), "/"), -1)).otherwise(
        F.concat(F.lit("tweet_"), F.col("position").cast("string"))
    )
    url = F.when(F.length(href) > 0, F.when(href.startswith("/"), F.concat(F.lit("https://twitter.com"), href)).otherwise(href)).otherwise(page)
    body = cut.withColumn("_t", strip(F.coalesce("text", F.lit("")))).filter(F.length("_t") > 0).select(
        *_item("twitter", user, post_id, F.col("_t"), url, "post"))
    return union_findings(bio, meta, body)


def professional_documents(profile: DataFrame, experience: DataFrame, activity: DataFrame, n: int | None = None) -> DataFrame:
    """Profile columns with candidates (name_1.., headline_1.., location_1.., about_1..) plus experience and activity
    rows (username, position, text) -> documents. The first candidate present counts, even when it is empty.
    """
    user = F.col("username")
    handle = lambda df: df.withColumn("username", normalise_handle(user, "professional"))
    page = F.concat(F.lit("https://www.linkedin.com/in/"), user, F.lit("/"))

    def first(stem: str) -> Column:
        names = sorted(c for c in profile.columns if c.startswith(stem + "_"))
        return F.coalesce(*[F.col(c) for c in names]) if names else F.lit(None).cast("string")

    bio = handle(profile).withColumn(
        "_t", join_non_blank(" | ", *[first(s) for s in ("name", "headline", "location", "about")])
    ).filter(F.length("_t") > 0).select(*_item("linkedin", user, F.concat(user, F.lit("_bio")), F.col("_t"), page, "bio"))

    def listed(df: DataFrame, tag: str, cap: int | None, url: Column) -> DataFrame:
        cut = limit_per_group(handle(df), "username", ["position"], cap)
        return cut.withColumn("_t", strip(F.coalesce("text", F.lit("")))).filter(F.length("_t") > 20).select(
            *_item("linkedin", user, F.concat(user, F.lit(f"_{tag}_"), F.col("position").cast("string")), F.col("_t"), url, "post"))

    feed = F.concat(page, F.lit("recent-activity/all/"))
    return union_findings(bio, listed(experience, "exp", None if n is None else n // 2, page), listed(activity, "activity", n, feed))


PLATFORMS: dict[str, Callable[..., DataFrame]] = {
    "twitter": microblog_documents, "reddit": forum_documents, "linkedin": professional_documents,
}


def social_documents(platform: str, *tables: DataFrame, **options) -> DataFrame:
    """Documents of a platform by name; an unknown name fails before any job runs."""
    name = platform.lower().strip()
    if name not in PLATFORMS:
        raise ValueError(f"Unsupported platform {name!r}. Choose from: {', '.join(PLATFORMS)}")
    return PLATFORMS[name](*tables, **options)


def image_documents(posts: DataFrame, extracted: str = "ocr_text") -> DataFrame:
    """Posts that link an image and have extracted text -> extra documents."""
    return posts.filter(F.lower("url").rlike(dims.IMAGE_URL) & (F.length(extracted) > 0)).select(
        "platform", "username", F.concat("post_id", F.lit("_img")).alias("post_id"), F.col(extracted).alias("content"),
        "url", F.lit("image_ocr").alias("content_type"),
    )
