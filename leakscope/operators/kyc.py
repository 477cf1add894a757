"""Identity documents: trigger phrases, document type, and the finding a scanned identity document yields."""
from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.scoring import severity_tier
from leakscope.functions.text import is_blank, let


def is_kyc(text: Column) -> Column:
    """Any trigger phrase, in any case."""
    hit = let(F.upper(text), lambda u: reduce(or_, [F.contains(u, F.lit(p)) for p in dims.KYC_PHRASES]))
    return F.coalesce(hit, F.lit(False))


def document_type(text: Column) -> Column:
    """Class with the most markers present; the first listed class wins ties; "unknown" without any marker."""

    def classify(low: Column) -> Column:
        def present(markers: list[str]) -> Column:
            return reduce(add, [F.contains(low, F.lit(m)).cast("int") for m in markers])

        ranked = F.array(
            *[
                F.struct(present(markers).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
                for i, (name, markers) in enumerate(dims.DOCUMENT_MARKERS.items())
            ]
        )
        best = F.array_max(ranked)
        return F.when(best["hits"] > 0, best["name"]).otherwise("unknown")

    return let(F.lower(text), classify)


def classify_document(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("document_type", document_type(F.col(text)))


def kyc_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """One KYC_SCAN finding per document that shows a trigger phrase."""
    score = F.lit("10.0").cast("decimal(4,1)")
    marker = F.lit("[KYC Document]")
    carried = [c for c in df.columns if c not in (text, "is_ocr_derived")]
    return df.filter(~is_blank(F.col(text)) & is_kyc(F.col(text))).select(
        *carried, F.lit("KYC_SCAN").alias("type"), marker.alias("value"), marker.alias("snippet"),
        score.alias("base_score"), severity_tier(score).alias("severity_tier"),
        F.lit("ocr+keyword_match").alias("validation_method"), F.lit("0.950").cast("decimal(6,3)").alias("confidence"),
        F.lit(True).alias("is_ocr_derived"),
    )
