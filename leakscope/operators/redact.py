"""Redaction: replace found values in the text by position, never by searching for the value."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.text import cut, is_blank, let, mask
from leakscope.operators.detect import SPAN, Pattern, with_spans

REDACTED = "***REDACTED***"


def _cover(value: Column, type_col: Column, mode: str) -> Column:
    if mode == "mask":
        return mask(value)
    if mode == "label":
        return F.concat(F.lit("["), type_col, F.lit("]"))
    if mode == "fixed":
        return F.lit(REDACTED)
    raise ValueError("mode must be 'mask', 'label' or 'fixed'")


def redacted(text: Column, spans: Column, mode: str = "mask", paged: Column | None = None) -> Column:
    """Text with every span covered. Spans must not overlap; their natural order must be their order in the text."""

    def assemble(ordered: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0))
            return F.concat(cut(text, since, s["start"] - since, paged), _cover(s["value"], s["type"], mode))

        tail = F.substring(text, F.element_at(ordered, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(ordered, part), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), assemble))


def redact_documents(
    documents: DataFrame, profile: str = "fast", patterns: Sequence[Pattern] | None = None, mode: str = "mask",
    text: str = "text",
) -> DataFrame:
    """Documents with their findings covered in place; `redactions` counts them. One stage, no join with findings.

    Every text is redacted, whole, whatever its file is called.
    """
    t = F.col(text)
    carried = [c for c in documents.columns if c != text]
    # a blank text is scanned as null, which has no spans
    shown = documents.withColumn("_scanned", F.when(~is_blank(t), t))
    spans = with_spans(shown, profile, patterns, None, "_scanned").withColumn(
        "_spans", F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")))
    return spans.select(*carried, redacted(t, F.col("_spans"), mode, F.col("_pages")).alias(text), F.size("_spans").alias("redactions"))
