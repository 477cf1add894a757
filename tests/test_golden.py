"""Golden rows for detection and validators."""
from pyspark.sql import functions as F

from leakscope.functions import validators as V
from leakscope.functions.text import mask
from leakscope.operators.detect import scan

FAST = {
    "call +919876543210 now": [("AADHAAR", "919876543210", 6, 18, 0.65)],
    "call +91 9876543210 now": [("PHONE", "+91 9876543210", 5, 19, 0.65)],
    "pay 4111 1111 1111 1111 today": [("AADHAAR", "4111 1111 1111", 4, 18, 0.65)],
    "card 4111 1111 1111 1111 today": [],
    "pay 4111111111111111 today": [("CREDIT_CARD", "4111111111111111", 4, 20, 0.65)],
    "aadhaar card 2341 2341 2346": [],
    "aadhaar 2341 2341 2346": [("AADHAAR", "2341 2341 2346", 8, 22, 0.75)],
    "PAN ABCPE1234F and ABCDE1234F": [("PAN", "ABCPE1234F", 4, 14, 0.75), ("PAN", "ABCDE1234F", 19, 29, 0.75)],
    "ssn 123-45-6789": [("SSN", "123-45-6789", 4, 15, 0.75)],
    "ssn 123-45-6789 sample": [],
    "ssn 666-45-6789": [],
    "9876543210@mail.com": [("EMAIL", "9876543210@mail.com", 0, 19, 0.65)],
    "IFSC HDFC0001234 DL KA01 20110012345": [("IFSC", "HDFC0001234", 5, 16, 0.75), ("DL_IN", "KA01 20110012345", 20, 36, 0.75)],
    "ABC1234567 A1234567": [("VOTER_ID", "ABC1234567", 0, 10, 0.65), ("PASSPORT_IN", "A1234567", 11, 19, 0.65)],
    "two 9876543210 9876543210": [("PHONE", "9876543210", 4, 14, 0.65), ("PHONE", "9876543210", 15, 25, 0.65)],
    "user@okaxis": [],
    "é9876543210 ñ 😀 9876543210": [("PHONE", "9876543210", 1, 11, 0.65), ("PHONE", "9876543210", 16, 26, 0.65)],
    "   \t\n ": [],
}
STRICT = {
    "call +919876543210 now": [("PHONE_NUMBER_INDIA", "+919876543210", 0.88)],
    "number 9876543210": [("PHONE_NUMBER_INDIA", "9876543210", 0.72)],
    "id 9876543210": [],
    "card 4111 1111 1111 1111 today": [("IN_CARD", "4111 1111 1111 1111", 0.85)],
    "card 4111 1111 1111 1112 today": [],
    "aadhaar 2341 2341 2346": [("IN_AADHAAR", "2341 2341 2346", 0.98)],
    "row 234123412346": [("IN_AADHAAR", "234123412346", 0.95)],
    "uid 234123412345": [("IN_AADHAAR", "234123412345", 0.45)],
    "row 234123412345": [],
    "PAN ABCPE1234F and ABCDE1234F": [("IN_PAN", "ABCPE1234F", 0.9)],
    "gst 27ABCPE1234F1Z5 and 38ABCPE1234F1Z5": [("IN_GSTIN", "27ABCPE1234F1Z5", 0.88)],
    "user@okaxis": [("IN_UPI", "user@okaxis", 0.88)],
    "upi user@okaxis": [("IN_UPI", "user@okaxis", 1.0)],
    "user@zz": [],
    "12-3456-7890-1234": [("IN_ABHA", "12-3456-7890-1234", 0.9)],
    "passport A1234567": [("IN_PASSPORT", "A1234567", 1.0)],
}


def run(spark, texts, profile):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return scan(df, profile, filename=None).orderBy("doc_id", "start").collect()


def test_fast(spark):
    texts = list(FAST)
    rows = run(spark, texts, "fast")
    for i, t in enumerate(texts):
        got = [(r.type, r.value, r.start, r.end, float(r.confidence)) for r in rows if r.doc_id == i]
        assert got == FAST[t], t


def test_strict(spark):
    texts = list(STRICT)
    rows = run(spark, texts, "strict")
    for i, t in enumerate(texts):
        got = [(r.type, r.value, float(r.confidence)) for r in rows if r.doc_id == i]
        assert got == STRICT[t], t
    bad_sum = [r for r in rows if float(r.confidence) == 0.45]
    assert bad_sum[0].annotation.startswith("Verhoeff checksum failed")


def test_context(spark):
    rows = run(spark, [
        "My email was leaked: a1@b.co", "pay 4111111111111111 now", "the size is 123-45-6789 px. my pan is ABCPE1234F",
        "a fake row ABCPE1234F", "nothing said ABCPE1234F",
    ], "context")
    got = {(r.doc_id, r.type): (float(r.confidence), r.risk, r.annotation) for r in rows}
    assert got[(0, "EMAIL")][:2] == (0.94, "Critical")
    assert got[(1, "CREDIT_CARD")] == (0.87, "Critical", "high-risk structural type")
    assert got[(2, "PAN")][:2] == (0.8, "High")
    assert (3, "PAN") not in got and (4, "PAN") not in got and (2, "SSN") not in got


def test_validators(spark):
    cases = [
        (V.verhoeff_ok, ["234123412346", "999941057058"], ["234123412345", "034123412346", "123412341234", "23412341234"]),
        (V.luhn_ok, ["4111111111111111", "4111 1111 1111 1111"], ["4111111111111112", "411111111111"]),
        (V.pan_ok, ["ABCPE1234F", "abcpe1234f"], ["ABCDE1234F"]),
        (V.gstin_ok, ["27ABCPE1234F1Z5"], ["38ABCPE1234F1Z5", "00ABCPE1234F1Z5", "27ABCDE1234F1Z5"]),
        (V.passport_ok, ["A1234567"], ["Q1234567", "A0234567"]),
        (V.licence_ok, ["KA0120110012345", "KA-01-2011-0012345"], ["KA01 20110012345"]),
        (V.upi_ok, ["user@okaxis", "ab@zz"], ["a@okaxis", "user@ok1"]),
        (V.abha_ok, ["12-3456-7890-1234"], ["12345678901234"]),
        (V.ssn_ok, ["123-45-6789", "912-45-6789"], ["000-45-6789", "666-45-6789", "123-00-6789", "123-45-0000"]),
        (V.phone_ok, ["9876543210", "+91-9876543210"], ["5876543210", "98765"]),
    ]
    for fn, good, bad in cases:
        for value in good + bad:
            got = spark.range(1).select(fn(F.lit(value)).alias("ok")).first().ok
            assert got == (value in good), (fn.__name__, value)


def test_mask(spark):
    row = spark.range(1).select(mask(F.lit("ABCPE1234F")).alias("a"), mask(F.lit("A1234567")).alias("b"), mask(F.lit(" xy ")).alias("c")).first()
    assert tuple(row) == ("ABCP****234F", "A1****", "xy****")


def test_column_clash(spark):
    import pytest

    with pytest.raises(ValueError):
        scan(spark.createDataFrame([("x", "y")], "type string, text string"), filename=None)
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([("y",)], "text string"), "odd", filename=None)
