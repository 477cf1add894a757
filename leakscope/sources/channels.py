"""Channel messages and extracted image text as documents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import normalise_handle
from leakscope.operators.kyc import is_kyc
from leakscope.operators.rollups import limit_per_group


def channel_documents(messages: DataFrame, n: int | None = None) -> DataFrame:
    """Messages with text; with n, those among the newest n of every channel.

    That cut is over all messages of a channel, so messages without text use up places, as a fetch limit does.
    """
    named = messages.withColumn("channel", normalise_handle(F.col("channel"), "channel")).filter(F.length("channel") > 0)
    newest = limit_per_group(named, "channel", [F.desc("message_id")], n)
    link = F.concat(F.lit("https://t.me/"), F.col("channel"), F.lit("/"), F.col("message_id").cast("string"))
    keep = [c for c in messages.columns if c not in ("url", "platform", "content_type")]
    return newest.filter(F.length("content") > 0).select(
        F.lit("telegram").alias("platform"), *keep, link.alias("url"), F.lit("message").alias("content_type")
    )


def messages_per_channel(documents: DataFrame) -> DataFrame:
    """Messages grouped by channel: count, first and last id."""
    return documents.groupBy("channel").agg(
        F.count(F.lit(1)).alias("messages"), F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id")
    )


def ocr_documents(texts: DataFrame) -> DataFrame:
    """Extracted text (source_url, repo_id, file_path, text) -> upload documents.

    Empty text is dropped; text of an identity document gets a marker line in front.
    """
    kyc = is_kyc(F.col("text"))
    marked = F.when(kyc, F.concat(F.lit(dims.KYC_MARKER_LINE + "\n"), F.col("text"))).otherwise(F.col("text"))
    return texts.filter(F.length("text") > 0).select(
        marked.alias("text"), F.concat("source_url", F.lit("_ocr")).alias("source_url"), "repo_id", "file_path",
        F.lit("upload").alias("platform"), F.lit(True).alias("is_ocr_derived"),
        F.create_map(F.lit("is_kyc"), kyc.cast("string"), F.lit("original_url"), F.col("source_url")).alias("metadata"),
    )


def extract_texts(binaries: DataFrame, extractor: Callable) -> DataFrame:
    """Run a user-supplied text extractor over (path, content) rows: pandas frames in, (path, text) frames out."""
    texts = binaries.select("path", "content").mapInPandas(extractor, "path string, text string")
    return texts.select(
        F.col("path").alias("source_url"), F.lit(None).cast("string").alias("repo_id"), F.col("path").alias("file_path"), "text"
    )
