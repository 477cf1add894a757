"""Pre-screening and chunking: reasons to skip a text, and pieces of long texts. Scans apply the screens on request only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import UNI_NOCASE, is_blank


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(text)))


def is_noise_filename(name: Column) -> Column:
    """Lock files, minified bundles, caches and version-control internals."""
    return F.coalesce(name.rlike(UNI_NOCASE + dims.SKIP_FILENAME), F.lit(False))


def is_binary(text: Column) -> Column:
    """More than 30 % of the first 500 characters are not ASCII (texts of up to 50 characters pass)."""
    head = F.substring(text, 1, 500)
    # a share test without division; the byte count is a cheap necessary condition that spares plain text the regex
    heavy = F.octet_length(head) * 10 > F.length(head) * 13
    foreign = F.length(F.regexp_replace(head, r"[\x00-\x7F]+", ""))
    return (F.length(head) > 50) & heavy & (foreign * 10 > F.length(head) * 3)


def is_minified(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", 1)) > 2000


def skip_reason(name: Column | None, text: Column, profile: str = "fast") -> Column:
    """Why a text is not scanned; null when it is.

    The minified test never fires in the live profiles (it looks at a prefix as long as its own limit), so it has an
    effect in the strict profile only.
    """
    out = F.lit(None).cast("string")
    cond = None
    if name is not None:
        cond = F.when(is_noise_filename(name), F.concat(F.lit("skipped: lock/minified file ("), name, F.lit(")")))
    cond = (cond.when if cond is not None else F.when)(is_binary(text), F.lit("skipped: likely binary"))
    if profile == "strict":
        cond = cond.when(is_minified(text), F.lit("skipped: minified single-line"))
    return cond.otherwise(out)


def with_skip_reason(df: DataFrame, text: str = "text", filename: str | None = "path", profile: str = "fast") -> DataFrame:
    return df.withColumn("skip_reason", skip_reason(F.col(filename) if filename else None, F.col(text), profile))


def screened(df: DataFrame, text: str = "text", filename: str | None = "path", profile: str = "fast") -> DataFrame:
    """Blank, noise and binary texts removed. Plain filters, so they run in the scan stage."""
    out = drop_blank(df, text).filter(~is_binary(F.col(text)))
    if filename:
        out = out.filter(~is_noise_filename(F.col(filename)))
    if profile == "strict":
        out = out.filter(~is_minified(F.col(text)))
    return out


def chunk_documents(
    df: DataFrame, size: int | None = dims.CHUNK_CHARS, overlap: int = 0, text: str = "text", spread_by: str | None = None,
    head: int = 0,
) -> DataFrame:
    """Cut long texts into slices of `size` characters (None: whole), one row each, with `chunk_no`, `chunk_start` and `lead`.

    `lead` counts characters before `chunk_start` that are included only as context (0 without overlap). With
    `overlap`, a slice also sees that many characters on both sides; a match belongs to the slice it starts in.
    `spread_by` (a key column) redistributes the slices, for inputs where few rows hold most of the text. `head` adds
    the first characters of the whole text to every slice.
    """
    t = F.col(text)
    opening = [F.substring(t, 1, head).alias("head")] if head else []

    def cut(at: Column) -> Column:
        lead = F.least(at, F.lit(overlap))
        part = F.substring(t, at - lead + 1, lead + F.lit(size + overlap))
        return F.struct((at / size).cast("int").alias("chunk_no"), at.alias("chunk_start"), lead.alias("lead"),
                        part.alias("part"), *opening)

    zero = F.lit(0)
    whole = F.array(F.struct(zero.alias("chunk_no"), zero.alias("chunk_start"), zero.alias("lead"), t.alias("part"), *opening))
    parts = whole if size is None else F.when(F.length(t) <= size, whole).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(size)), cut)
    )
    rest = [c for c in df.columns if c != text]
    # explode_outer: the plain form makes the optimizer add a size() filter that evaluates the cuts a second time
    out = df.select(*rest, F.explode_outer(parts).alias("_c")).select(
        *rest, "_c.chunk_no", "_c.chunk_start", "_c.lead", F.col("_c.part").alias(text), *(["_c.head"] if head else [])
    )
    return out.repartition(F.col(spread_by), F.col("chunk_no")) if spread_by else out
