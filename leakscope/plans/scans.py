"""The scans a user calls. All users, repositories, pastes and channels of the inputs are scanned in one job each.

A result holds lazy DataFrames; nothing runs until one of them is used.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import normalise_handle, strip
from leakscope.operators import ess as E
from leakscope.operators import rollups as R
from leakscope.operators.detect import FINDING_FIELDS, Pattern, scan
from leakscope.operators.numbering import checkpointed
from leakscope.sources import files as FL
from leakscope.sources.channels import channel_documents
from leakscope.sources.pastes import COLUMNS as PASTE_COLUMNS
from leakscope.sources.social import forum_documents


@dataclass(frozen=True)
class ScanResult:
    """`scanned` counts every source looked at per scan, `ess` only those with findings. `errors` has a row for every listed source
    whose contents haven't landed."""

    findings: DataFrame
    ess: DataFrame
    summary: DataFrame
    scanned: DataFrame
    errors: DataFrame | None = field(default=None, repr=False, compare=False)
    rebuild: Callable[[DataFrame], ScanResult] | None = field(default=None, repr=False, compare=False)

    def stored(self) -> ScanResult:
        """The same result over findings written once to the shared checkpoint folder.

        Use it when more than one part of a result is read: otherwise each part scans the texts again.
        """
        return self.rebuild(checkpointed(self.findings)) if self.rebuild else self


def _scored(found: DataFrame, scanned: DataFrame, vocab: str,
            finish: Callable[[DataFrame], DataFrame] = lambda summary: summary, errors: DataFrame | None = None) -> ScanResult:
    def build(rows: DataFrame) -> ScanResult:
        scored = E.ess(rows, ["scan_id", "source_key"], "source_type", vocab)
        return ScanResult(rows, scored, finish(E.scan_summary(scored, "scan_id")), scanned, errors, build)

    return build(found)


def _small(rows: DataFrame) -> bool:
    """Whether Spark's estimate of a frame is below the size up to which it broadcasts."""
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def listed_findings(listing: DataFrame, contents: DataFrame, on: Sequence[str], profile: str = "fast", patterns: Sequence[Pattern] | None = None,
                    scorer: Callable | None = None, colocated: bool = False) -> DataFrame:
    """Findings of the listed contents, with all columns of the listing. Texts are scanned where they are read, each once, whoever lists
    it; only findings are shuffled to the listing.

    A listing that is small is first used to leave out other contents, by a broadcast. `colocated`: both are tables in equal buckets
    by `on` (`sources.layout`), so the join comes first and needs no exchange.
    """
    on = list(on)
    texts = contents.select(*on, "text")
    if colocated:
        return scan(listing.join(texts, on), profile, patterns, scorer, filename=None)
    keys = listing.select(*on)
    if _small(keys):
        texts = texts.join(F.broadcast(keys.distinct()), on, "left_semi")  # its size has been looked at
    return listing.join(scan(texts, profile, patterns, scorer, filename=None), on)


def missing_contents(listing: DataFrame, contents: DataFrame, on: Sequence[str], kind: str, target: Column, path: Column) -> DataFrame:
    """An error row for every listed source without landed text, in the form of the alert stream's. Reads no text, only whether there
    is one."""
    there = contents.filter(F.col("text").isNotNull()).select(*on)
    lost = listing.join(there, list(on), "left_anti")
    return lost.select(F.lit("error").alias("type"), "scan_id", F.lit(kind).alias("kind"), target.alias("target"), path.alias("path"),
                       F.lit("Scan failed: no content").alias("message"))


def _listing(files: DataFrame) -> DataFrame:
    return files.drop("type", "size", "name", "route")


def _scan_listing(files: DataFrame, contents: DataFrame, source_key: Column, profile: str, vocab: str, patterns: Sequence[Pattern] | None,
                  scorer: Callable | None, colocated: bool) -> ScanResult:
    listing, on = _listing(files), ["repo", "branch", "path"]
    found = listed_findings(listing, contents, on, profile, patterns, scorer, colocated).withColumns({
        "source_key": source_key, "file_path": F.col("path"), "source": F.concat(F.lit("GitHub: "), F.col("repo"), F.lit("/"), F.col("path")),
        "source_url": FL.browse_url(F.col("repo"), F.col("branch"), F.col("path")), "source_type": F.lit("github_public"),
    })
    scanned = files.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_sources_scanned"))
    return _scored(found, scanned, vocab, errors=missing_contents(listing, contents, on, "github", F.col("repo"), F.col("path")))


def scan_repo(files: DataFrame, contents: DataFrame, branch: str = "main", max_files: int | None = None, profile: str = "fast",
              vocab: str = "canonical", patterns: Sequence[Pattern] | None = None, scorer: Callable | None = None,
              colocated: bool = False) -> ScanResult:
    """Every listed repository as its own scan, one score per file. Listings decide what is read: see `listed_findings`."""
    chosen = FL.scannable_files(FL.resolve_branch(files, branch), max_files).withColumn("scan_id", F.col("repo"))
    return _scan_listing(chosen, contents, F.col("path"), profile, vocab, patterns, scorer, colocated)


def _owner_files(repos: DataFrame, files: DataFrame, max_repos: int | None, max_files: int | None) -> DataFrame:
    newest = FL.latest_repos(repos, max_repos).select(
        "owner", F.col("full_name").alias("repo"), F.col("default_branch").alias("branch"))
    return FL.scannable_files(files.join(newest, ["repo", "branch"]), max_files)


def scan_user_repos(repos: DataFrame, files: DataFrame, contents: DataFrame, max_repos: int | None = None, max_files: int | None = None,
                    profile: str = "fast", vocab: str = "canonical", patterns: Sequence[Pattern] | None = None,
                    scorer: Callable | None = None) -> ScanResult:
    """Every owner's repositories (with `max_repos`, the newest), one score per repository."""
    chosen = _owner_files(repos, files, max_repos, max_files).withColumn("scan_id", F.col("owner"))
    return _scan_listing(chosen, contents, F.col("repo"), profile, vocab, patterns, scorer, False)


def scan_pastes(pastes: DataFrame, contents: DataFrame, profile: str = "fast", vocab: str = "canonical",
                patterns: Sequence[Pattern] | None = None, scorer: Callable | None = None,
                scan_id: str = "pastes") -> ScanResult:
    """Listed pastes with their landed contents (paste_id, text), one score per paste."""
    listed = pastes.select(*PASTE_COLUMNS).withColumn("scan_id", F.lit(scan_id))
    found = listed_findings(listed, contents, ["paste_id"], profile, patterns, scorer).withColumns({
        "source_key": F.col("paste_id"), "file_path": F.col("paste_id"), "source_type": F.lit("pastebin"),
        "source": F.concat(F.lit("Pastebin: "), F.col("paste_id")), "source_url": F.col("url"),
    })
    scanned = listed.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_sources_scanned"))
    errors = missing_contents(listed, contents, ["paste_id"], "pastebin", F.col("paste_id"), F.col("paste_id"))
    return _scored(found, scanned, vocab, errors=errors)


def forum_scan_documents(items: DataFrame) -> DataFrame:
    """Forum items with provenance columns; `content` becomes `text`."""
    user, post = F.col("username"), F.col("post_id")
    return items.withColumnRenamed("content", "text").withColumns({
        "source_key": F.concat(F.lit("forum/"), user), "file_path": F.concat(F.lit("reddit/"), user, F.lit("/"), post),
        "source": F.concat(F.lit("Reddit: u/"), user, F.lit(" ["), F.col("content_type"), F.lit("]")),
        "source_url": F.col("url"), "filename": F.concat(F.lit("reddit_"), post), "source_type": F.lit("social_reddit"),
    })


def channel_scan_documents(messages: DataFrame) -> DataFrame:
    channel, mid = F.col("channel"), F.col("message_id").cast("string")
    return messages.withColumnRenamed("content", "text").withColumns({
        "source_key": F.concat(F.lit("channel/"), channel),
        "file_path": F.concat(F.lit("telegram/"), channel, F.lit("/"), mid),
        "source": F.concat(F.lit("Telegram: "), channel), "source_url": F.col("url"),
        "filename": F.concat(F.lit("telegram_"), channel, F.lit("_"), mid), "source_type": F.lit("telegram"),
    })


SOCIAL = ["scan_id", "source_key", "file_path", "source", "source_url", "platform", "content_type", "filename",
          "source_type", "text"]


def scan_social(forum_json: DataFrame | None, messages: DataFrame | None, max_posts: int | None = None, per_channel: int | None = None,
                profile: str = "fast", vocab: str = "canonical", patterns: Sequence[Pattern] | None = None,
                scorer: Callable | None = None, scan_id: str = "social") -> ScanResult:
    """Forum users and channels together: one score per user and per channel."""
    parts, listed = [], []
    if forum_json is not None:
        parts.append(forum_scan_documents(forum_documents(forum_json, max_posts)))
        user = normalise_handle(F.col("username"), "forum")
        listed.append(forum_json.select(F.concat(F.lit("forum/"), user).alias("source_key")))
    if messages is not None:
        parts.append(channel_scan_documents(channel_documents(messages, per_channel)))
        channel = normalise_handle(F.col("channel"), "channel")
        listed.append(messages.select(F.concat(F.lit("channel/"), channel).alias("source_key")))
    if not parts:
        raise ValueError("give forum bodies, channel messages or both")
    docs = R.union_findings(*[p.withColumn("scan_id", F.lit(scan_id)).select(*SOCIAL) for p in parts])
    scanned = E.sources_scanned(R.union_findings(*listed).withColumn("scan_id", F.lit(scan_id)), "source_key")
    return _scored(scan(docs, profile, patterns, scorer, filename=None), scanned, vocab)


def profile_entries(profiles: DataFrame) -> DataFrame:
    """One row per profile entry: lower-case kind, trimmed value, label (the kind when it has none)."""
    rows = profiles.select("user_email", F.posexplode("entries").alias("entry_no", "_e"))
    kind = F.lower("_e.kind")
    return rows.select(
        "user_email", "entry_no", kind.alias("kind"), strip(F.col("_e.value")).alias("value"),
        F.when(F.length("_e.label") > 0, F.col("_e.label")).otherwise(kind).alias("label"),
    )


def found_for_users(documents: DataFrame, users: DataFrame, handle: str, profile: str = "fast", patterns: Sequence[Pattern] | None = None,
                    scorer: Callable | None = None) -> DataFrame:
    """Findings of the documents under a handle, once for every user entry that names it; the documents are scanned once. Columns of the
    entries take the place of equal ones of the documents."""
    ours = [c for c in documents.columns if c == handle or c not in users.columns]
    return scan(documents.select(*ours), profile, patterns, scorer, filename=None).join(users.withColumnRenamed("value", "entry_value"), handle)


def scan_profiles(profiles: DataFrame, repos: DataFrame, files: DataFrame, contents: DataFrame, forum_json: DataFrame,
                  messages: DataFrame, profile: str = "fast", vocab: str = "canonical",
                  patterns: Sequence[Pattern] | None = None, scorer: Callable | None = None, max_repos: int | None = None,
                  max_files: int | None = None, max_posts: int | None = None, per_channel: int | None = None) -> ScanResult:
    """Everybody's profile map in one job; the scan id is the user.

    Repository entries read the owner's repositories, forum entries a user's posts, channel entries the messages, all of
    them or the newest so many; any other entry is scanned as text itself. An entry without landed documents contributes nothing and
    disturbs nobody else. A text is scanned once, however many users name it.
    """
    entries = profile_entries(profiles)
    user = [F.col("user_email").alias("scan_id"), "entry_no", "kind", "label", "value"]

    repo_rows = entries.filter(F.col("kind") == "github").select(*user).withColumn(
        "owner", normalise_handle(F.col("value"), "profile_repo_user"))
    chosen = _owner_files(repos, files, max_repos, max_files)
    repo_files, on = chosen.join(repo_rows.drop("value"), "owner"), ["repo", "branch", "path"]
    repo_found = listed_findings(_listing(repo_files), contents, on, profile, patterns, scorer).withColumns({
        "source_key": F.concat_ws("/", F.col("entry_no").cast("string"), F.lit("github"), F.col("repo")), "file_path": F.col("path"),
        "source": F.concat(F.lit("GitHub ("), F.col("label"), F.lit("): "), F.col("repo"), F.lit("/"), F.col("path")),
        "source_url": FL.browse_url(F.col("repo"), F.col("branch"), F.col("path")),
        "platform": F.lit("github"), "content_type": F.lit(None).cast("string"), "filename": F.col("path"),
        "source_type": F.lit("github_public"),
    })

    forum_rows = entries.filter(F.col("kind") == "reddit").select(*user).withColumn(
        "username", normalise_handle(F.col("value"), "profile_forum"))
    forum_docs = forum_scan_documents(forum_documents(forum_json, max_posts))
    forum_found = found_for_users(forum_docs, forum_rows, "username", profile, patterns, scorer).withColumns({
        "source": F.concat(F.lit("Reddit ("), F.col("label"), F.lit("): u/"), F.col("username")),
        "source_key": F.concat_ws("/", F.col("entry_no").cast("string"), F.col("source_key")),
    })

    channel_rows = entries.filter(F.col("kind") == "telegram").select(*user).withColumn(
        "channel", normalise_handle(F.col("value"), "profile_channel"))
    channel_docs = channel_scan_documents(channel_documents(messages, per_channel))
    channel_found = found_for_users(channel_docs, channel_rows, "channel", profile, patterns, scorer).withColumns({
        "source": F.concat(F.lit("Telegram ("), F.col("label"), F.lit("): "), F.col("channel")),
        "source_key": F.concat_ws("/", F.col("entry_no").cast("string"), F.col("source_key")),
        "filename": F.concat(F.lit("telegram_"), F.col("channel")),
    })

    other = entries.filter(~F.col("kind").isin("github", "reddit", "telegram")).select(*user)
    value, kind = F.col("value"), F.col("kind")
    other_docs = other.withColumns({
        "text": value, "source_key": F.concat_ws("/", F.col("entry_no").cast("string"), F.lit("profile"), kind),
        "file_path": F.concat(F.lit("profile/"), kind),
        "source": F.concat(F.initcap(kind), F.lit(" ("), F.col("label"), F.lit("): "), value),
        "source_url": F.when(value.startswith("http"), value).otherwise(""), "platform": kind,
        "content_type": F.lit(None).cast("string"), "filename": F.concat(F.lit("profile_"), kind),
        "source_type": F.lit("social_reddit"),
    })
    other_found = scan(other_docs.drop("value"), profile, patterns, scorer, filename=None)
    carried = [c for c in SOCIAL if c != "text"]
    found = R.union_findings(*[d.select(*carried, *FINDING_FIELDS) for d in (repo_found, forum_found, channel_found, other_found)])
    # files count one by one for repository entries, every other entry counts once
    one_each = entries.filter(F.col("kind") != "github").select(F.col("user_email").alias("scan_id"))
    scanned = repo_files.select("scan_id").unionByName(one_each).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_sources_scanned"))
    everyone = profiles.select(F.col("user_email").alias("scan_id"))
    errors = missing_contents(_listing(repo_files), contents, on, "github", F.col("repo"), F.col("path"))
    return _scored(found, scanned, vocab, lambda summary: E.summary_or_empty(summary, everyone, "scan_id", "NONE"), errors)


def scan_combined(repo_result: ScanResult, paste_result: ScanResult, scan_id: str = "combined", avg: str = "as_is") -> ScanResult:
    """Both findings together and the merged summary."""
    renamed = [r.summary.withColumn("scan_id", F.lit(scan_id)) for r in (repo_result, paste_result)]
    counts = R.union_findings(repo_result.scanned, paste_result.scanned).agg(
        F.sum("total_sources_scanned").alias("total_sources_scanned")).withColumn("scan_id", F.lit(scan_id))
    return ScanResult(
        R.union_findings(repo_result.findings, paste_result.findings),
        R.union_findings(repo_result.ess, paste_result.ess),
        R.combine_scans(*renamed, by="scan_id", avg=avg), counts,
    )


def history_rows(result: ScanResult, scan_type: str, duration: float | None = None, user: str | Column | None = None) -> DataFrame:
    """History rows of a result, one per scan id (which becomes the target). `user` is who asked: one name, or a column made of
    scan_id; without it rows have no user_email and `append_history` can't be read back by user."""
    counts = result.findings.groupBy("scan_id").agg(F.count(F.lit(1)).cast("int").alias("findings_count"))
    joined = result.scanned.join(counts, "scan_id", "left").join(result.summary, "scan_id", "left")
    who = [] if user is None else [(F.lit(user) if isinstance(user, str) else user).alias("user_email")]
    return joined.select(
        *who, F.lit(scan_type).alias("scan_type"), F.col("scan_id").alias("target"),
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"), F.coalesce("max_ess", F.lit(0.0)).alias("max_ess"),
        F.coalesce("label", F.lit(dims.ESS_FLOOR[0])).alias("ess_label"),
        F.col("total_sources_scanned").cast("int").alias("sources_scanned"), F.lit(duration).cast("double").alias("scan_duration"),
    )
