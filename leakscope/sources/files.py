"""Repository listings and file contents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import literal_array
from leakscope.operators.rollups import limit_per_group


def decode_utf8(content: Column) -> Column:
    """Bytes -> text; invalid sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Documents from files. parquet and json keep their columns; text and binary give (path, size, text), a row a file."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.input_file_name().alias("path"), F.octet_length("value").cast("long").alias("size"), F.col("value").alias("text")
        )
    if fmt == "binary":
        files = spark.read.format("binaryFile").load(path)
        return files.select("path", F.col("length").alias("size"), decode_utf8(F.col("content")).alias("text"))
    raise ValueError(f"unknown format {fmt!r}")


def apply_size_policy(df: DataFrame, kind: str, content: str = "content", limit: int | None = None) -> DataFrame:
    """Bytes column -> text column. With a limit, larger repository files are dropped and pastes are cut to it."""
    body = F.col(content)
    rest = [c for c in df.columns if c != content]
    if kind not in ("repo", "paste"):
        raise ValueError("kind must be 'repo' or 'paste'")
    if limit is None:
        return df.select(*rest, decode_utf8(body).alias("text"))
    if kind == "repo":
        return df.filter(F.octet_length(body) <= limit).select(*rest, decode_utf8(body).alias("text"))
    return df.select(*rest, decode_utf8(F.substring(body, 1, limit)).alias("text"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot does not start one, nor does a trailing one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(parents, literal_array(dims.SKIP_DIRS))


def filter_tree(files: DataFrame) -> DataFrame:
    """Blobs outside noise directories."""
    return files.filter((F.col("type") == "blob") & ~in_skipped_dir(F.col("path")))


def route(path: Column, size: Column, limit: int | None = None) -> Column:
    """How a file is read, by its suffix. With a limit, larger files are skipped."""
    kind = suffix(path)
    by_kind = F.when(kind.isin(dims.TEXT_SUFFIXES), "text").when(kind.isin(dims.OCR_SUFFIXES), "ocr").otherwise("skip")
    return by_kind if limit is None else F.when(size > limit, "skip").otherwise(by_kind)


def classify_route(files: DataFrame, limit: int | None = None) -> DataFrame:
    return files.withColumns({
        "name": file_name(F.col("path")),
        "route": route(F.col("path"), F.coalesce(F.col("size"), F.lit(0)), limit),
    })


def raw_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit("https://raw.githubusercontent.com/"), repo, F.lit("/"), branch, F.lit("/"), path)


def browse_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), branch, F.lit("/"), path)


def with_source_urls(files: DataFrame, repo: str = "repo") -> DataFrame:
    cols = F.col(repo), F.col("branch"), F.col("path")
    return files.withColumns({"raw_url": raw_url(*cols), "source_url": browse_url(*cols)})


def files_by_route(files: DataFrame, wanted: str) -> DataFrame:
    return classify_route(filter_tree(files)).filter(F.col("route") == wanted)


def scannable_files(files: DataFrame, per_repo: int | None = None) -> DataFrame:
    """The text files of every repository; with `per_repo`, the first ones in tree order."""
    return limit_per_group(files_by_route(files, "text"), ["repo", "branch"], ["path"], per_repo)


def resolve_branch(files: DataFrame, branch: str = "main", fallback: str = "master") -> DataFrame:
    """Files of the asked branch; a repository that has no such branch (and was asked for main) gives its master."""
    if branch != "main":
        return files.filter(F.col("branch") == branch)
    both = files.filter(F.col("branch").isin(branch, fallback))
    # the choice is one row per repository, made before files are joined to it
    chosen = both.groupBy("repo").agg(F.max(F.col("branch") == branch).alias("_main")).select(
        "repo", F.when(F.col("_main"), branch).otherwise(fallback).alias("branch")
    )
    return both.join(chosen, ["repo", "branch"], "left_semi")


def latest_repos(repos: DataFrame, n: int | None = None) -> DataFrame:
    """Every owner's public repositories; with n, the newest ones."""
    public = repos.filter(~F.coalesce(F.col("private"), F.lit(False)))
    named = public.withColumn("default_branch", F.coalesce("default_branch", F.lit("main")))
    return limit_per_group(named, "owner", [F.desc("updated_at"), "full_name"], n)
