"""The live rules read a second time in plain Python, against the DataFrame result on random text."""
import random
import re

from leakscope import dims
from leakscope.operators.detect import scan
from leakscope.operators.redact import redact_documents

PIECES = ["234123412346", "2341 2341 2346", "+91", "9876543210", " ", "-", "4111111111111111", "ABCPE1234F", "A1234567", "ABC1234567",
          "KA01 20110012345", "123-45-6789", "HDFC0001234", "u.x@mail.example.com", "a@b", "é", "😀", "٣", "\n", ".", "aadhaar ", "card ",
          "my ", "sample ", "size ", "leaked ", "0", "7", "x", "ß", ",", "phone number ", "@"]


def oracle(text):
    found = []
    for ordinal, (kind, regex) in enumerate(dims.LIVE_PATTERNS):
        for m in re.finditer(regex, text):
            around = text[max(0, m.start() - 100):m.end() + 100]
            digits = re.sub(r"\D", "", m.group())
            if kind == "AADHAAR" and (digits[0] in "01" or re.search(dims.AADHAAR_VETO, around, re.I)):
                continue
            if kind == "SSN":
                a, b, c = (int(x) for x in m.group().split("-"))
                if a in (0, 666) or not b or not c or re.search(dims.TECHNICAL_CONTEXT, around, re.I) or re.search(dims.DUMMY_CONTEXT, around, re.I):
                    continue
            near = text[max(0, m.start() - 80):m.end() + 80]
            conf = 0.75 if re.search(dims.PII_KEYWORDS, near, re.I) else 0.65
            found.append((-conf, ordinal, m.start(), m.end(), kind, m.group()))
    kept = []
    for f in sorted(found):
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return sorted((f[2], f[3], f[4], f[5].strip(), -f[0]) for f in kept)


def test_random_texts(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in scan(df, filename=None).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type, r.value, float(r.confidence)))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == oracle(t), repr(t)
    assert len(got) > 1500
    screened = {r.doc_id for r in scan(df, filename=None, screen=True).collect()}
    looks_binary = {i for i, t in enumerate(texts) if len(t[:500]) > 50 and sum(ord(c) > 127 for c in t[:500]) / len(t[:500]) > 0.3}
    assert screened == set(got) - looks_binary


def test_many_overlaps_in_one_text(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice(PIECES) for _ in range(6000))
    df = spark.createDataFrame([(0, "a" * 600 + " " + text)], "doc_id long, text string")
    rows = scan(df, filename=None).collect()
    got = sorted((r.start, r.end, r.type, r.value, float(r.confidence)) for r in rows)
    assert got == oracle("a" * 600 + " " + text)
    assert len(got) > 400
    ends = [g[1] for g in got]
    assert all(e <= s[0] for e, s in zip(ends, got[1:]))


def test_chunks_with_overlap_equal_whole(spark):
    rnd = random.Random(5)
    texts = ["x " * 30 + "".join(rnd.choice(PIECES) for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cols = ["doc_id", "type", "value", "start", "end", "confidence"]
    whole = sorted(map(tuple, scan(df, filename=None).select(*cols).collect()))
    # slices see more than twice the widest context on both sides
    parts = sorted(map(tuple, scan(df, filename=None, chunk_size=400, overlap=400).select(*cols).collect()))
    assert whole == parts
    cut = scan(df, filename=None, chunk_size=400).select(*cols).collect()
    assert all(r.end - r.start > 0 for r in cut) and len(cut) <= len(whole) + 60


def test_cuts_lose_nothing(spark):
    df = spark.createDataFrame([(0, "a" * 95 + " 9876543210 tail")], "doc_id long, text string")
    assert scan(df, filename=None, chunk_size=100).count() == scan(df, filename=None).count() == 1
    long = "x" * 299_990 + " 4111111111111111 end"
    far = spark.createDataFrame([(0, long)], "doc_id long, text string")
    for profile in ("fast", "context", "extended", "strict"):
        at = [[(r.start, r.end) for r in scan(far, profile, filename=None, **how).collect()] for how in ({}, {"chunk_size": 300_000})]
        assert at[0] == at[1] == [(299_991, 300_007)], profile
    assert "4111111111111111" not in redact_documents(far).first().text
    row = scan(df, filename=None, chunk_size=100, overlap=50).first()
    assert (row.type, row.start, row.end) == ("PHONE", 96, 106)
