"""Golden scores, summaries and their order independence."""
import pytest

from leakscope.operators.ess import ess, scan_summary, summary_or_empty

CASES = [
    (["EMAIL"], [0.65], "github_public", "as_is", 2.0, 1.0, 1.3, 0.525, 2.08),
    (["EMAIL"], [0.65], "pastebin", "as_is", 2.0, 1.0, 1.15, 0.525, 1.78),
    (["EMAIL_ADDRESS"], [0.65], "github_public", "canonical", 3.0, 1.0, 1.3, 0.525, 3.38),
    (["IN_PAN"], [0.90], "pastebin", "canonical", 8.0, 1.0, 1.15, 0.15, 9.05),
    (["EMAIL_ADDRESS", "PHONE_NUMBER_INDIA"], [0.65, 0.75], "social_reddit", "canonical", 4.5, 1.3, 1.0, 0.45, 5.4),
    (["IN_UPI", "PHONE_NUMBER_INDIA"], [0.88, 0.72], "pastebin", "canonical", 5.5, 1.6, 1.15, 0.3, 9.82),
    (["IN_AADHAAR", "IN_PAN"], [0.95, 0.90], "github_public", "canonical", 9.0, 1.55, 1.3, 0.113, 10.0),
    (["EMAIL", "PHONE"], [0.65, 0.75], "social_reddit", "canonical", 4.5, 1.3, 1.0, 0.45, 5.4),
    (["AADHAAR", "PAN", "PHONE"], [0.75] * 3, "unknown", "canonical", 9.0, 1.9, 1.0, 0.375, 10.0),
    (["SSN"], [0.75], "telegram", "canonical", 2.0, 1.0, 1.0, 0.375, 1.63),
]


@pytest.mark.parametrize("vocab", ["canonical", "as_is"])
def test_golden(spark, vocab):
    rows = [(str(i), st, t, c) for i, (types, confs, st, v, *_) in enumerate(CASES) if v == vocab for t, c in zip(types, confs)]
    df = spark.createDataFrame(rows, "source_key string, source_type string, type string, confidence double")
    got = {r.source_key: r for r in ess(df, vocab=vocab).collect()}
    for i, (types, _c, _st, v, base, toxic, radius, penalty, score) in enumerate(CASES):
        if v == vocab:
            r = got[str(i)]
            assert (r.base_score, r.toxic_multiplier, r.exposure_multiplier, r.confidence_penalty, r.score) == (base, toxic, radius, penalty, score)
            assert r.breakdown.final_score == score and len(r.types_found) == len(types)


def test_unknown_vocab(spark):
    df = spark.createDataFrame([("a", "b", "EMAIL", 0.6)], "source_key string, source_type string, type string, confidence double")
    with pytest.raises(ValueError):
        ess(df, vocab="other")


def test_summary_and_empty(spark):
    rows = [("s1", "a", "x", "EMAIL", 0.65), ("s1", "b", "x", "PAN", 0.75), ("s1", "b", "x", "PAN", 0.75)]
    df = spark.createDataFrame(rows, "scan_id string, source_key string, source_type string, type string, confidence double")
    summary = scan_summary(ess(df, ["scan_id", "source_key"]))
    scans = spark.createDataFrame([("s1",), ("s2",)], "scan_id string")
    got = {r.scan_id: r for r in summary_or_empty(summary, scans, empty_label="NONE").collect()}
    assert (got["s1"].max_ess, got["s1"].avg_ess, got["s1"].total_sources, got["s1"].label) == (7.63, 5.06, 2, "HIGH")
    assert got["s1"].all_types == ["EMAIL_ADDRESS", "IN_PAN"]
    assert (got["s2"].max_ess, got["s2"].label, got["s2"].all_types) == (0.0, "NONE", [])
