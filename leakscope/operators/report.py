"""Report of a scan: tables per section, and HTML fragments in order.

Sections other than the findings list are bounded and become one fragment per scan. The findings list is one fragment
per finding, so a scan with a very large number of findings is never assembled in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions import scoring as S
from leakscope.functions.text import html_escape, literal_array, lookup
from leakscope.operators import rollups as R
from leakscope.operators.guide import GUIDES, NO_FINDINGS, NOTHING_TO_DO
from leakscope.operators.numbering import number_rows

IMPACT = {kind: g.harm for kind, g in GUIDES.items()}
REMEDY = {kind: g.step for kind, g in GUIDES.items()}
PLATFORM_LABEL = {"github": "GitHub", "pastebin": "Pastebin", "combined": "GitHub + Pastebin"}


def display_name(type_col: Column) -> Column:
    return lookup(dims.DISPLAY_NAMES, type_col, type_col)


def risk_color(risk: Column) -> Column:
    return lookup(dims.RISK_COLORS, risk, F.lit("#aaaaaa"))


def confidence_color(conf: Column) -> Column:
    return F.when(conf >= 0.8, "#4caf50").when(conf >= 0.5, "#ffc107").otherwise("#ff5722")


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def _strong(*parts: Column) -> Column:
    return F.concat(F.lit("<strong>"), *parts, F.lit("</strong>"))


def _one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def executive_summary() -> Column:
    """Text over the columns target, scan_type, total, critical, high, top_type, top_count, max_ess and label: what was
    found, what most of it is, how bad it is and what to do."""
    total, worst = F.col("total"), F.coalesce(F.col("max_ess"), F.lit(0.0))
    name = _strong(html_escape(F.col("target")))
    severe = F.col("critical") + F.col("high")
    todo = (
        F.when(worst >= 7.0, "Act today: revoke, remove and notify.").when(worst >= 4.0, "Plan a clean-up this week.")
        .otherwise("Keep an eye on it.")
    )
    parts = [
        name, F.lit(" ("), lookup(PLATFORM_LABEL, F.col("scan_type"), F.lit("other sources")), F.lit("): "),
        _strong(_plural(total, "finding")), F.lit(", "), severe.cast("string"), F.lit(" of them critical or high. Most common: "),
        display_name(F.col("top_type")), F.lit(", "), F.col("top_count").cast("string"), F.lit("x. Worst exposure "),
        _strong(_one_decimal(worst), F.lit(" of 10, "), F.coalesce(F.col("label"), F.lit("INFO"))), F.lit(". "), todo,
    ]
    return F.when(total == 0, F.concat(name, F.lit(": no identifiers, no action needed."))).otherwise(F.concat(*parts))


def report_tables(findings: DataFrame, scored: DataFrame, summary: DataFrame, scans: DataFrame, by: str = "scan_id",
                  vocab: str = "canonical") -> dict[str, DataFrame]:
    """All section tables keyed by scan. `scans` has one row per scan: target, scan_type, files_scanned, scan_duration."""
    typed = findings.withColumn("type", S.canonical_type(F.col("type"), vocab))
    top = R.top_type(typed, by).select(by, F.col("type").alias("top_type"), F.col("findings").alias("top_count"))
    zero = F.lit(0)
    overview = (
        scans.join(R.alert_summary(findings, by), by, "left").join(top, by, "left").join(summary, by, "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("total", "critical", "high", "medium")})
    )
    types = R.type_distribution(typed, by)
    return {
        "overview": overview.withColumn("executive_summary", executive_summary()),
        "gauge": overview.select(by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("max_ess", "avg_ess")],
                                 F.coalesce("total_sources", zero).alias("sources"),
                                 F.coalesce("label", F.lit("INFO")).alias("label"),
                                 F.coalesce("color", F.lit("#aaaaaa")).alias("color"),
                                 S.ess_band_ui(F.coalesce(F.col("max_ess"), F.lit(0.0))).alias("band_ui")),
        "risk": R.risk_distribution(findings, by),
        "types": types.withColumns({
            "display_name": display_name(F.col("type")), "impact": lookup(IMPACT, F.col("type"), F.lit("")),
        }),
        "combos": R.scan_combos(scored, by),
        "confidence": R.confidence_bands(findings, by),
        "remediation": types.select(by, "type", display_name(F.col("type")).alias("display_name"),
                                    F.try_element_at(F.create_map(*[F.lit(x) for kv in REMEDY.items() for x in kv]),
                                                     F.col("type")).alias("advice")).filter(F.col("advice").isNotNull()),
    }


def finding_row(number: Column) -> Column:
    """One line of the findings list."""
    link = F.when(
        F.length(F.coalesce("source_url", F.lit(""))) > 0,
        F.concat(F.lit('<a href="'), html_escape(F.col("source_url")), F.lit('">'), html_escape(F.col("source")), F.lit("</a>")),
    ).otherwise(html_escape(F.col("source")))
    shown = html_escape(F.col("masked_snippet"))
    pct = F.concat(F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))
    cells = [
        number.cast("string"), display_name(F.col("type")), html_escape(F.col("value_masked")),
        F.concat(F.lit('<span style="color:'), confidence_color(F.col("confidence")), F.lit('">'), pct, F.lit("</span>")),
        F.concat(F.lit('<span style="color:'), risk_color(F.col("risk")), F.lit('">'), F.col("risk"), F.lit("</span>")),
        link, shown, html_escape(F.col("annotation")),
    ]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(c, F.lit("—")), F.lit("</td>")) for c in cells],
                    F.lit("</tr>"))


def report_fragments(findings: DataFrame, scored: DataFrame, summary: DataFrame, scans: DataFrame, by: str = "scan_id",
                     order: tuple[str, ...] = ("source", "doc_id", "start", "type"), vocab: str = "canonical") -> DataFrame:
    """(scan, section, row_no, html), to be read in that order. `findings` must have source, source_url and the order columns."""
    tables = report_tables(findings, scored, summary, scans, by, vocab)

    def section(no: int, df: DataFrame, html: Column, row_no: Column | None = None) -> DataFrame:
        return df.select(by, F.lit(no).alias("section"),
                         (row_no if row_no is not None else F.lit(0)).cast("bigint").alias("row_no"), html.alias("html"))

    def li(*parts: Column) -> Column:
        return F.concat(F.lit("<li>"), *parts, F.lit("</li>"))

    def opened(no: int, title: str) -> DataFrame:
        return section(no, scans, F.lit(f"<h2>{title}</h2>"), F.lit(-1))

    num = lambda c: F.col(c).cast("string")
    duration = F.when(F.col("scan_duration") > 0, F.concat(_one_decimal(F.col("scan_duration")), F.lit("s"))).otherwise("—")
    header = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>Exposed identifiers: '),
        html_escape(F.col("target")), F.lit("</title></head><body><h1>Exposed identifiers</h1><ul>"),
        li(html_escape(F.col("target"))), li(lookup(PLATFORM_LABEL, F.col("scan_type"), F.col("scan_type"))),
        li(num("files_scanned"), F.lit(" files scanned")), li(num("total"), F.lit(" findings")), li(duration), F.lit("</ul>"),
    )
    gauge = F.concat(F.lit("<ul>"), li(F.lit("Worst "), _one_decimal(F.col("max_ess")), F.lit(" "), F.col("label")),
                     li(F.lit("Mean "), _one_decimal(F.col("avg_ess"))), li(F.lit("Sources "), num("sources")), F.lit("</ul>"))
    risk = F.concat(F.lit("<p>"), F.col("risk"), F.lit(": "), num("findings"), F.lit(" ("), F.format_string("%.0f", "pct"), F.lit("%)</p>"))
    pct0 = lambda c: F.concat(F.round(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    kinds = F.concat(F.lit("<p>"), F.col("display_name"), F.lit(": "), num("findings"), F.lit(", avg "), pct0("avg_confidence"),
                     F.lit(", "), pct0("min_confidence"), F.lit(" – "), pct0("max_confidence"), F.lit(". "),
                     html_escape(F.col("impact")), F.lit("</p>"))
    combos = F.concat(F.lit("<p>"), html_escape(F.col("toxic_combo_label")), F.lit(" — "),
                      F.format_string("%.2f", "toxic_multiplier"), F.lit("times as severe</p>"))
    bands = F.concat(F.lit("<ul>"), li(F.lit("High "), num("high")), li(F.lit("Medium "), num("medium")), li(F.lit("Low "), num("low")),
                     li(F.lit("Average "), _one_decimal(F.col("avg_confidence") * 100), F.lit("%")),
                     li(F.lit("Validated "), num("validated")), li(F.lit("Annotated "), num("annotated")), F.lit("</ul>"))
    remedy = F.concat(F.lit("<p><strong>"), F.col("display_name"), F.lit("</strong> "), html_escape(F.col("advice")), F.lit("</p>"))
    typed = findings.withColumn("type", S.canonical_type(F.col("type"), vocab))
    if "masked_snippet" not in typed.columns:  # raw snippets are not shown
        typed = typed.withColumn("masked_snippet", F.lit(None).cast("string"))
    listed = number_rows(typed, by, list(order))
    without_remedy = scans.select(by).join(tables["remediation"].select(by).distinct(), by, "left_anti")
    without_findings = scans.join(findings.select(by).distinct(), by, "left_anti")
    with_findings = scans.select(by).join(findings.select(by).distinct(), by, "left_semi")
    combo_scans = tables["combos"].select(by).distinct()
    parts = [
        section(0, tables["overview"], header),
        opened(1, "At a glance"), section(1, tables["overview"], F.col("executive_summary")),
        opened(2, "How exposed"), section(2, tables["gauge"], gauge),
        opened(3, "By level of risk"), section(3, tables["risk"], risk, F.col("risk_rank")),
        opened(4, "By kind of data"), section(4, tables["types"], kinds, F.col("type_rank")),
        opened(5, "Every finding"), section(5, with_findings, F.lit("<table>")),
        section(5, listed, finding_row(F.col("row_no")), F.col("row_no")),
        section(5, without_findings, F.lit(f"<p>{NO_FINDINGS}</p>")),
        section(6, with_findings, F.lit("</table>")),
        section(7, combo_scans, F.lit("<h2>Kinds that are worse together</h2>"), F.lit(-1)),
        section(7, tables["combos"], combos, (F.lit(1000) - F.round(F.col("toxic_multiplier") * 100, 0))),
        section(8, tables["confidence"], F.concat(F.lit("<h2>How sure</h2>"), bands)),
        opened(9, "What owners can do"),
        section(9, tables["remediation"], remedy, F.array_position(literal_array(list(REMEDY)), F.col("type"))),
        section(9, without_remedy, F.lit(f"<p>{NOTHING_TO_DO}</p>")),
        section(10, scans, F.lit("</body></html>")),
    ]
    return R.union_findings(*parts)
