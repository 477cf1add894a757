"""Scores, labels and classes as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions.text import let, literal_array, literal_map, lookup, matches

CONF = "decimal(6,3)"
PROB = "decimal(12,9)"


def dec(value: str, kind: str = CONF) -> Column:
    return F.lit(value).cast(kind)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def half_up(total: Column, n: Column) -> Column:
    """total / n as an integer, halves rounded up (both non-negative integers)."""
    return int_div(total * 2 + n, n * 2)


def fast_score(ctx: Column) -> Column:
    """0.65, or 0.75 when the surrounding text names a kind of personal data or a disclosure."""
    return F.when(matches(ctx, dims.PII_KEYWORDS), dec(dims.FAST_KEYWORD)).otherwise(dec(dims.FAST_BASE))


def label_mass(scores: Column, labels: list[str]) -> Column:
    """Summed probability of the given labels in a label -> probability map."""
    picked = F.map_filter(scores, lambda k, v: k.isin(labels))
    return F.aggregate(
        F.map_values(picked), F.lit(0).cast("decimal(14,9)"), lambda acc, v: (acc + v.cast(PROB)).cast("decimal(14,9)")
    )


def label_max(scores: Column, labels: list[str]) -> Column:
    picked = F.map_filter(scores, lambda k, v: k.isin(labels))
    return F.coalesce(F.array_max(F.transform(F.map_values(picked), lambda v: v.cast(PROB))), F.lit(0).cast(PROB))


def top_label(scores: Column) -> Column:
    """Label with the highest probability (the alphabetically first on a tie)."""
    best = F.array_sort(
        F.map_entries(scores),
        lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return F.get(best, F.lit(0))["key"]


def context_base(type_col: Column, scores: Column, has_sentence: Column) -> Column:
    """Starting risk: fixed for cards, fixed without a sentence, else high-risk mass with the low-risk cap."""
    high = label_mass(scores, dims.HIGH_RISK_LABELS).cast(PROB)
    capped = F.when(
        label_max(scores, dims.LOW_RISK_LABELS) > F.lit(dims.LOW_RISK_LIMIT).cast(PROB),
        F.least(high, dec(dims.LOW_RISK_CAP, PROB)),
    ).otherwise(high)
    return (
        F.when(type_col == "CREDIT_CARD", dec(dims.CARD_BASE, PROB))
        .when(~has_sentence, dec(dims.NO_SENTENCE_BASE, PROB))
        .otherwise(F.coalesce(capped, dec("0", PROB)))
    )


def context_score(base: Column, keyword: Column, owned: Column, person_near: Column) -> Column:
    """Keyword floor, then the ownership and person boosts, each capped at 1, rounded to three places."""
    one = dec("1", PROB)
    risk = F.when(keyword, F.greatest(base, dec(dims.KEYWORD_FLOOR, PROB))).otherwise(base)
    risk = F.when(owned, F.least((risk + dec(dims.OWNERSHIP_BOOST, PROB)).cast(PROB), one)).otherwise(risk)
    risk = F.when(person_near, F.least((risk + dec(dims.PERSON_BOOST, PROB)).cast(PROB), one)).otherwise(risk)
    return F.round(risk, 3).cast(CONF)


def context_reason(type_col: Column, scores: Column, has_sentence: Column) -> Column:
    return (
        F.when(type_col == "CREDIT_CARD", F.lit("high-risk structural type"))
        .when(~has_sentence, F.lit("no sentence context"))
        .otherwise(F.coalesce(top_label(scores), F.lit("")))
    )


def leak_severity(score: Column) -> Column:
    return F.when(score >= dec(dims.CONFIRMED_AT), "CONFIRMED_LEAK").when(score >= dec(dims.PROBABLE_AT), "PROBABLE_LEAK")


def risk_class(type_col: Column, severity: Column | None = None) -> Column:
    by_type = lookup(dims.RISK, type_col, F.lit("Low"))
    if severity is None:
        return by_type
    return F.when(severity == "CONFIRMED_LEAK", "Critical").when(severity == "PROBABLE_LEAK", "High").otherwise(by_type)


def risk_rank(risk: Column) -> Column:
    return lookup({r: i for i, r in enumerate(dims.RISK_LEVELS)}, risk, F.lit(len(dims.RISK_LEVELS)))


def canonical_type(type_col: Column, vocab: str = "canonical") -> Column:
    """Scanner type -> the name that weights, combinations and texts are keyed by."""
    if vocab == "as_is":
        return type_col
    if vocab != "canonical":
        raise ValueError(f"vocab must be 'canonical' or 'as_is', not {vocab!r}")
    return lookup(dims.TYPE_ALIAS, type_col, type_col)


def sensitivity(type_col: Column) -> Column:
    weights = literal_map(dims.SENSITIVITY)
    return F.coalesce(F.try_element_at(weights, type_col), F.lit(dims.DEFAULT_SENSITIVITY)).cast("decimal(4,1)")


def exposure_radius(source_type: Column) -> Column:
    return lookup(dims.EXPOSURE_RADIUS, source_type, F.lit("1.00")).cast("decimal(4,2)")


def toxic_combo(types: Column) -> Column:
    """struct(multiplier, label) of the strongest combination fully contained in an array of types; 1 and "none"."""
    found = F.lit(None).cast("struct<multiplier:decimal(4,2),label:string>")
    ranked = sorted(dims.TOXIC_COMBOS, key=lambda c: c[1], reverse=True)
    branches = [
        (
            F.size(F.array_except(literal_array(members), types)) == 0,
            F.struct(F.lit(mult).cast("decimal(4,2)").alias("multiplier"), F.lit(label).alias("label")),
        )
        for members, mult, label in ranked
    ]
    none = F.struct(F.lit("1.00").cast("decimal(4,2)").alias("multiplier"), F.lit("none").alias("label"))
    found = F.when(*branches[0])
    for cond, value in branches[1:]:
        found = found.when(cond, value)
    return found.otherwise(none)


def _ladder(score: Column, steps, floor) -> Column:
    out = None
    for limit, value in steps:
        cond = score >= F.lit(limit).cast("decimal(4,1)")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(floor)


def ess_label(score: Column) -> Column:
    return _ladder(score, [(b[0], b[1]) for b in dims.ESS_BANDS], dims.ESS_FLOOR[0])


def ess_color(score: Column) -> Column:
    return _ladder(score, [(b[0], b[2]) for b in dims.ESS_BANDS], dims.ESS_FLOOR[1])


def ess_band_ui(score: Column) -> Column:
    """Bands of the browser gauge, which differ from the labels."""
    return _ladder(score, [("8.0", "Critical"), ("6.0", "High"), ("4.0", "Medium")], "Low")


def severity_tier(score: Column) -> Column:
    return _ladder(score, dims.TIER_BANDS, dims.TIER_FLOOR)


def fake_keyword(snippet: Column) -> Column:
    """First marker of invented data contained in the lower-cased snippet, by list order; null when there is none."""
    words = literal_array(dims.FAKE_KEYWORDS)
    return let(F.lower(snippet), lambda low: F.get(F.filter(words, lambda k: F.contains(low, k)), F.lit(0)))
