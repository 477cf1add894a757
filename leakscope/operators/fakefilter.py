"""Invented-data filter: lowers the confidence of findings whose surroundings look like test data, drops hopeless ones."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.scoring import CONF, canonical_type, fake_keyword, label_mass, top_label
from leakscope.operators.scores import KeptScores, classified, with_scores

PROB3 = "decimal(4,3)"


def is_fake(snippet: Column, scores: Column | None = None) -> Column:
    """struct(is_fake, p, label). Keyword path first; then class probabilities; without either, not fake."""
    word = fake_keyword(snippet)
    by_word = F.struct(
        F.lit(True).alias("is_fake"), F.lit("0.950").cast(PROB3).alias("p"),
        F.concat(F.lit("keyword match: "), word).alias("label"),
    )
    none = F.struct(
        F.lit(False).alias("is_fake"), F.lit("0").cast(PROB3).alias("p"), F.lit("model unavailable").alias("label")
    )
    out = F.when(word.isNotNull(), by_word)
    if scores is not None:
        mass = label_mass(scores, dims.FAKE_LABELS)
        by_model = F.struct(
            (mass > F.lit("0.55").cast("decimal(4,2)")).alias("is_fake"), F.round(mass, 3).cast(PROB3).alias("p"),
            top_label(scores).alias("label"),
        )
        out = out.when(scores.isNotNull(), by_model)
    return out.otherwise(none)


def filter_fake(findings: DataFrame, scorer: Callable | None = None, vocab: str = "canonical", kept: KeptScores | None = None) -> DataFrame:
    """Downgrade likely fakes among the eligible types and drop eligible findings left below 0.15.

    `scorer` (pandas frames, `snippet` -> `snippet`, `scores`) classifies every distinct snippet once, whole; without it only the
    keyword path applies. With `kept`, snippets that earlier runs have classified are looked up instead. With a scorer the findings are
    read several times, so those of a scan should have been written (`checkpointed`).
    """
    columns = findings.columns
    eligible = canonical_type(F.col("type"), vocab).isin(dims.FAKE_ELIGIBLE)
    if scorer is not None:
        asked = F.when(eligible & fake_keyword(F.col("snippet")).isNull(), F.md5("snippet"))
        findings = findings.withColumn("_text", asked)
        table = classified(findings.filter(F.col("_text").isNotNull()), "snippet", scorer, kept)
        findings = with_scores(findings, table, "_text")
        verdict = is_fake(F.col("snippet"), F.col("_scores"))
    else:
        verdict = is_fake(F.col("snippet"))
    judged = findings.withColumn("_v", F.when(eligible, verdict))
    fake = F.coalesce(F.col("_v.is_fake"), F.lit(False))
    lowered = F.round(
        F.col("confidence").cast(CONF) * (F.lit("1.0000").cast("decimal(6,4)") - F.col("_v.p") * F.lit("0.8").cast("decimal(2,1)")), 3
    ).cast(CONF)
    note = F.concat(F.lit("NLP: likely fake ("), F.col("_v.label"), F.lit(", p="),
                    F.round("_v.p", 2).cast("decimal(4,2)").cast("string"), F.lit(")"))
    judged = judged.withColumn("confidence", F.when(fake, lowered).otherwise(F.col("confidence").cast(CONF))).withColumn(
        "annotation",
        F.when(fake & (F.coalesce(F.length("annotation"), F.lit(0)) > 0), F.concat(F.col("annotation"), F.lit("; "), note))
        .when(fake, note).otherwise(F.col("annotation")),
    )
    kept = judged.filter(~eligible | (F.col("confidence") >= F.lit("0.150").cast(CONF)))
    return kept.select(*columns)
