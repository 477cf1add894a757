"""Detection: documents in, findings out.

One narrow stage: screening, chunking, pattern matching, validation, scoring, overlap resolution and masking are
expressions over a single row. Nothing is shuffled, so the same functions work on streams.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import dims
from leakscope.functions import scoring as S
from leakscope.functions import validators as V
from leakscope.functions.spans import between_spans, blocked, holder, match_spans, resolve_overlaps
from leakscope.functions.text import UNI, context, cut, is_blank, let, mask, masked_snippet, matches, pages, snippet, strip
from leakscope.operators.screen import chunk_documents, is_binary, is_minified, is_noise_filename

# start comes first: the natural order of spans is their order in the text
SPAN = (
    "struct<start:int,end:int,ordinal:int,type:string,value:string,confidence:decimal(6,3),severity:string,"
    "decision:string>"
)
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
PROFILES = ("fast", "context", "extended", "strict")

Check = Callable[[str, Column, Column], Column]
Scorer = Callable[[Column], Column]

# Cheap necessary conditions: a text that fails one cannot match any pattern of that group. Each starts with a plain
# character class so that the regex engine skips ordinary prose quickly; alternations at the top level do not.
DIGIT_RUNS = r"\d{3}(?:\d{4}|\d?[\s\-]\d{2})"
CAPITALS = r"[A-Z]{4}[0A-Z]"
AT_SIGN = "@"
GATES = {
    "AADHAAR": DIGIT_RUNS, "PASSPORT_IN": DIGIT_RUNS, "VOTER_ID": DIGIT_RUNS, "DL_IN": DIGIT_RUNS, "SSN": DIGIT_RUNS,
    "CREDIT_CARD": DIGIT_RUNS, "PHONE": DIGIT_RUNS, "ABHA": DIGIT_RUNS, "PAN": CAPITALS, "GSTIN": CAPITALS,
    "IFSC": CAPITALS, "EMAIL": AT_SIGN, "UPI": AT_SIGN,
}


def gate_holds(text: Column, gate: str) -> Column:
    return F.contains(text, F.lit(AT_SIGN)) if gate == AT_SIGN else text.rlike(UNI + gate)


@dataclass(frozen=True)
class Pattern:
    """One row of the pattern dimension."""

    type: str
    regex: str
    ordinal: int
    gate: str | None = None
    check: Check | None = None


def _built_in(rows: list[tuple[str, str]], check: Check) -> tuple[Pattern, ...]:
    return tuple(Pattern(t, regex, i, GATES.get(t), check) for i, (t, regex) in enumerate(rows))


LIVE = _built_in(dims.LIVE_PATTERNS, V.live_check)
EXTENDED = _built_in(dims.EXTENDED_PATTERNS, V.full_check)


def register_pattern(
    patterns: Sequence[Pattern], type_name: str, regex: str, validator: Callable[[Column, Column], Column] | None = None,
    ordinal: int | None = None, gate: str | None = None,
) -> tuple[Pattern, ...]:
    """A pattern set with one more type. `validator(value, context)` is a Column predicate; `ordinal` is the tie rank.

    `gate` may hold a cheaper regex that every matching text must contain.
    """
    check = (lambda _t, v, c: validator(v, c)) if validator else None
    at = len(patterns) if ordinal is None else ordinal
    shifted = [replace(p, ordinal=p.ordinal + 1) if p.ordinal >= at else p for p in patterns]
    return tuple(sorted([*shifted, Pattern(type_name, regex, at, gate, check)], key=lambda p: p.ordinal))


def select_patterns(patterns: Sequence[Pattern], *types: str) -> tuple[Pattern, ...]:
    unknown = set(types) - {p.type for p in patterns}
    if unknown:
        raise ValueError(f"no pattern for {sorted(unknown)}")
    return tuple(p for p in patterns if p.type in types)


# --- span arrays -------------------------------------------------------------------------------------------------


def _span(p_ordinal, p_type, s, confidence, severity, decision) -> Column:
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(p_ordinal).alias("ordinal"),
        F.lit(p_type).alias("type"), s["value"].alias("value"), confidence.cast("decimal(6,3)").alias("confidence"),
        severity.cast("string").alias("severity"), decision.cast("string").alias("decision"),
    )


def _no_spans(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _valid_matches(text: Column, p: Pattern, paged: Column | None) -> Column:
    found = match_spans(text, p.regex)
    if p.check is None:
        return found
    return F.filter(found, lambda s: p.check(p.type, s["value"], context(text, s["start"], s["end"], 100, paged)))


def _gated(text: Column, patterns: Sequence[Pattern], build: Callable[[Pattern], Column], kind: str) -> Column:
    """Concatenate per-pattern arrays; patterns that share a gate are evaluated only where the gate holds."""
    groups: dict[str | None, list[Pattern]] = {}
    for p in patterns:
        groups.setdefault(p.gate, []).append(p)
    parts = []
    for gate, members in groups.items():
        arrays = F.concat(*[build(p) for p in members])
        parts.append(arrays if gate is None else F.when(gate_holds(text, gate), arrays).otherwise(_no_spans(kind)))
    return F.concat(*parts) if parts else _no_spans(kind)


def any_gate(text: Column, gates: Sequence[str]) -> Column:
    """One predicate per distinct gate, cheapest first."""
    distinct = sorted(dict.fromkeys(gates), key=len)
    out = gate_holds(text, distinct[0])
    for gate in distinct[1:]:
        out = out | gate_holds(text, gate)
    return out


def doc_gate(patterns: Sequence[Pattern], text: Column) -> Column | None:
    """Row filter implied by the gates of all patterns, or None when some pattern has no gate."""
    gates = [p.gate for p in patterns]
    return None if not gates or None in gates else any_gate(text, gates)


def fast_spans(text: Column, patterns: Sequence[Pattern] = LIVE, paged: Column | None = None) -> Column:
    """Validated matches with the keyword-based confidence, before overlap resolution."""

    def build(p: Pattern) -> Column:
        return F.transform(
            _valid_matches(text, p, paged),
            lambda s: _span(p.ordinal, p.type, s, S.fast_score(context(text, s["start"], s["end"], 80, paged)),
                            F.lit(None), F.lit("fast regex match")),
        )

    return _gated(text, patterns, build, SPAN)


# --- context profile ---------------------------------------------------------------------------------------------

FEATURE = (
    "struct<ordinal:int,type:string,start:int,end:int,value:string,sentence_key:string,has_sentence:boolean,"
    "keyword:boolean,owned:boolean,scores:map<string,double>>"
)


def lexical_scorer(sentence: Column) -> Column:
    """Default class probabilities from words alone: no model, no Python worker, the same result on every run."""
    def dist(high: str, mid: str, fake: str, masked: str, technical: str) -> Column:
        third = float(high)
        values = dict(zip(dims.HIGH_RISK_LABELS, (third, 0.0, 0.0)))
        values[dims.MID_RISK_LABELS[0]] = float(mid)
        values.update(zip(dims.LOW_RISK_LABELS, (float(fake), float(masked), float(technical))))
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])

    return (
        F.when(matches(sentence, dims.TECHNICAL_CONTEXT), dist("0.30", "0.20", "0.05", "0.05", "0.40"))
        .when(matches(sentence, r"\b(leaked|disclosed|exposed|accidentally|mistakenly|confidential)\b"),
              dist("0.84", "0.10", "0.02", "0.02", "0.02"))
        .when(matches(sentence, dims.OWNERSHIP), dist("0.62", "0.20", "0.06", "0.06", "0.06"))
        .otherwise(dist("0.50", "0.30", "0.10", "0.05", "0.05"))
    )


def sentence_spans(text: Column) -> Column:
    """Sentences of a text: cut after a full stop, exclamation or question mark before white space, and at newlines."""
    return between_spans(text, SENTENCE_BREAK)


RAW = "struct<ordinal:int,type:string,start:int,end:int,value:string>"


def raw_spans(text: Column, patterns: Sequence[Pattern] = LIVE, paged: Column | None = None) -> Column:
    """Validated matches without a score."""

    def build(p: Pattern) -> Column:
        return F.transform(
            _valid_matches(text, p, paged),
            lambda s: F.struct(F.lit(p.ordinal).alias("ordinal"), F.lit(p.type).alias("type"),
                               s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")),
        )

    return _gated(text, patterns, build, RAW)


SIGNALS = ("keyword", "owned", "dummy")


def _signals(ctx: Column) -> list[Column]:
    return [matches(ctx, dims.PII_KEYWORDS).alias("keyword"), matches(ctx, dims.OWNERSHIP).alias("owned"),
            matches(ctx, dims.DUMMY_CONTEXT).alias("dummy")]


def described_sentences(text: Column, scorer: Scorer | None) -> Column:
    """Sentences with their word signals and scores. Each is judged once, however many matches it holds."""

    def one(x: Column) -> Column:
        scores = scorer(x["value"]) if scorer else F.lit(None)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                        F.md5(x["value"]).alias("key"), (~is_blank(x["value"])).alias("filled"), *_signals(x["value"]),
                        scores.cast("map<string,double>").alias("scores"))

    return F.transform(sentence_spans(text), one)


def describe_spans(found: Column, sentences: Column, whole: Column) -> Column:
    """Raw spans with the signals of their sentence (`whole` where none holds them); masked values and dummy sentences
    are gone. No text is copied."""
    none = F.lit(None).cast("map<string,double>")

    def one(s: Column) -> Column:
        def build(x: Column) -> Column:
            held = x["start"].isNotNull()
            pick = lambda name: F.when(held, x[name]).otherwise(whole[name])
            return F.struct(
                s["ordinal"].alias("ordinal"), s["type"].alias("type"), s["start"].alias("start"),
                s["end"].alias("end"), s["value"].alias("value"), x["key"].alias("sentence_key"),
                F.coalesce(x["filled"], F.lit(False)).alias("has_sentence"), pick("keyword").alias("keyword"),
                pick("owned").alias("owned"), F.coalesce(x["scores"], none).alias("scores"),
                (matches(s["value"], dims.MASKED_VALUE) | pick("dummy")).alias("dropped"),
            )

        return let(holder(sentences, s), build)

    kept = F.filter(F.transform(found, one), lambda f: ~f["dropped"])
    return F.transform(kept, lambda f: f.dropFields("dropped")).cast(f"array<{FEATURE}>")


@lru_cache(maxsize=128)
def _raw(text: str, patterns: tuple[Pattern, ...], _session: int) -> Column:
    """Building these expressions takes thousands of calls, more time than a small table's scan, so they are kept."""
    return raw_spans(F.col(text), patterns, F.col("_pages"))


@lru_cache(maxsize=128)
def _judged_sentences(text: str, _session: int) -> Column:
    return described_sentences(F.col(text), lexical_scorer)


@lru_cache(maxsize=128)
def _described(_session: int) -> tuple[Column, Column]:
    """Blocks of sentences, and the features of the spans."""
    return blocked(F.col("_sentences")), describe_spans(F.col("_raw"), F.col("_blocks"), F.col("_whole"))


def with_context_features(df: DataFrame, text: str, patterns: Sequence[Pattern] = LIVE, scorer: Scorer | None = None) -> DataFrame:
    """Adds `_features`, `_sentences` and `_pages`: one projection per step, because a step uses the one before it
    many times. Expressions around a scorer of the caller's own are built anew every time."""
    t, some, session = F.col(text), F.size("_raw") > 0, id(SparkContext._gateway)
    out = df.withColumn("_pages", pages(t)).withColumn("_raw", _raw(text, tuple(patterns), session))
    sentences = _judged_sentences(text, session) if scorer is lexical_scorer else described_sentences(t, scorer)
    blocks, spans = _described(session)
    out = out.withColumn("_sentences", F.when(some, sentences))
    first = F.get("_sentences", F.lit(0))  # a text that is one sentence has been judged
    judged = F.when((first["start"] == 0) & (first["end"] == F.length(t)), F.struct(*[first[c].alias(c) for c in SIGNALS])).otherwise(F.struct(*_signals(t)))
    out = out.withColumns({"_blocks": blocks, "_whole": F.when(some, judged)})
    features = F.when(some, spans).otherwise(_no_spans(FEATURE))
    return out.withColumn("_features", features).drop("_raw", "_blocks", "_whole")


def score_feature(f: Column, scores: Column, person_near: Column) -> Column:
    """Feature + class probabilities + entity flag -> span; the caller drops spans without a severity."""
    has_sentence = f["has_sentence"]
    base = S.context_base(f["type"], scores, has_sentence)
    return let(
        S.context_score(base, f["keyword"], f["owned"], person_near),
        lambda c: _span(f["ordinal"], f["type"], f, c, S.leak_severity(c),
                        S.context_reason(f["type"], scores, has_sentence)),
    )


def scored_features(features: Column) -> Column:
    scored = F.transform(features, lambda f: score_feature(f, f["scores"], F.lit(False)))
    return F.filter(scored, lambda s: s["severity"].isNotNull())


# --- strict profile ----------------------------------------------------------------------------------------------

STRICT_TYPES = ["IN_AADHAAR", "PHONE_NUMBER_INDIA", "IN_PAN", "IN_GSTIN", "IN_UPI", "IN_ABHA", "IN_CARD",
                "IN_PASSPORT", "EMAIL_ADDRESS"]
CONTEXT_BOOST = "0.350"  # documented default gain of the public recogniser framework for a context word
CONTEXT_REACH = 80


def strict_aadhaar_spans(text: Column, paged: Column | None = None) -> Column:
    """Grouped, then solid twelve digits; a good checksum gives 0.95 (0.98 near a naming word), a bad one 0.45 there."""

    def one(s: Column) -> Column:
        named = matches(context(text, s["start"], s["end"], 100, paged), dims.STRICT_AADHAAR_CONTEXT)
        return let(
            F.struct(V.verhoeff_ok(s["value"]).alias("valid"), named.alias("named")),
            lambda q: F.when(
                q["valid"],
                _span(0, "IN_AADHAAR", s, F.when(q["named"], S.dec("0.980")).otherwise(S.dec("0.950")), F.lit(None),
                      F.lit("")),
            ).when(
                q["named"],
                _span(0, "IN_AADHAAR", s, S.dec("0.450"), F.lit(None),
                      F.lit("Verhoeff checksum failed — possible false positive")),
            ),
        )

    found = F.concat(match_spans(text, dims.STRICT_AADHAAR_GROUPED), match_spans(text, dims.STRICT_AADHAAR_SOLID))
    not_phone = F.filter(found, lambda s: ~F.regexp_replace(s["value"], r"(?U)\D", "").rlike("^91[6-9]"))
    return F.filter(F.transform(not_phone, one), lambda s: s.isNotNull())


def strict_phone_spans(text: Column, paged: Column | None = None) -> Column:
    """Prefixed numbers always; bare ones only near a telephone word and clear of prefixed ones."""

    def with_prefixed(prefixed: Column) -> Column:
        # both forms end with the same run of ten digits, so they overlap exactly when their ends agree
        bare = let(F.transform(prefixed, lambda p: p["end"]), lambda ends: F.filter(
            match_spans(text, dims.STRICT_PHONE_BARE),
            lambda b: ~F.array_contains(ends, b["end"])
            & matches(context(text, b["start"], b["end"], 80, paged), dims.STRICT_PHONE_CONTEXT),
        ))
        emit = lambda conf: (
            lambda s: _span(1, "PHONE_NUMBER_INDIA", s, S.dec(conf), F.lit(None), F.lit(""))
        )
        return F.concat(F.transform(prefixed, emit("0.880")), F.transform(bare, emit("0.720")))

    return let(match_spans(text, dims.STRICT_PHONE_PREFIXED), with_prefixed)


def _word_before(text: Column, s: Column, words: list[str], paged: Column | None) -> Column:
    alternation = "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True))
    left = F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))
    return matches(cut(text, left, s["start"] - left, paged), rf"\b({alternation})\b")


def strict_spans(text: Column, paged: Column | None = None) -> Column:
    """Validator-first detection: base score per pattern, context gain, threshold, then the validated score."""

    def recogniser(type_name: str, regexes: list[tuple[str, str]], valid) -> Column:
        ordinal = STRICT_TYPES.index(type_name)

        def spans_of(regex: str, base: str) -> Column:
            def one(s: Column) -> Column:
                if type_name in dims.STRICT_VALIDATED:
                    conf = S.dec(dims.STRICT_VALIDATED[type_name])
                else:
                    conf = F.when(
                        _word_before(text, s, dims.STRICT_CONTEXT_WORDS[type_name], paged),
                        F.least(S.dec(base) + S.dec(CONTEXT_BOOST), S.dec("1.000")),
                    ).otherwise(S.dec(base))
                return _span(ordinal, type_name, s, conf, F.lit(None), F.lit(""))

            found = match_spans(text, regex)
            if valid is not None:
                found = F.filter(found, lambda s: valid(s["value"]))
            # the threshold is on the base score, which every pattern here meets
            assert float(base) >= float(dims.STRICT_THRESHOLD)
            return F.transform(found, one)

        return F.concat(*[spans_of(r, b) for r, b in regexes])

    handles = "|".join(dims.STRICT_UPI_HANDLES)
    upi = rf"\b[a-zA-Z0-9.\-_]{{2,40}}@(?:{handles})\b"
    live = dict(dims.LIVE_PATTERNS)
    digits = F.concat(
        strict_aadhaar_spans(text, paged), strict_phone_spans(text, paged),
        recogniser("IN_ABHA", [(dims.ABHA_PATTERN, dims.STRICT_BASE["IN_ABHA"])], V.abha_ok),
        recogniser("IN_CARD", [(dims.STRICT_CARD_GROUPED, "0.800"), (dims.STRICT_CARD_SOLID, "0.550")], V.luhn_ok),
        recogniser("IN_PASSPORT", [(dims.STRICT_PASSPORT, dims.STRICT_BASE["IN_PASSPORT"])], None),
    )
    letters = F.concat(
        recogniser("IN_PAN", [(live["PAN"], dims.STRICT_BASE["IN_PAN"])], V.pan_ok),
        recogniser("IN_GSTIN", [(dims.GSTIN_PATTERN, dims.STRICT_BASE["IN_GSTIN"])], V.gstin_ok),
    )
    addresses = F.concat(
        recogniser("IN_UPI", [(upi, dims.STRICT_BASE["IN_UPI"])], V.upi_ok),
        recogniser("EMAIL_ADDRESS", [(live["EMAIL"], "1.000")], None),
    )
    gate = lambda g, arr: F.when(gate_holds(text, g), arr).otherwise(_no_spans())
    return F.concat(gate(DIGIT_RUNS, digits), gate(CAPITALS, letters), gate(AT_SIGN, addresses))


# --- findings ----------------------------------------------------------------------------------------------------

FINDING_FIELDS = ["type", "value", "value_masked", "snippet", "confidence", "risk", "annotation", "start", "end"]


def finding_struct(text: Column, s: Column, chunk_start: Column, lead: Column, paged: Column | None = None,
                   masked: Column | None = None, wanted: Sequence[str] | None = None) -> Column:
    """The finding of a span. A generator evaluates every field of its structs, so those that aren't `wanted` are left out here."""
    shift = chunk_start - lead
    fields = [
        s["type"].alias("type"), strip(s["value"]).alias("value"), mask(s["value"]).alias("value_masked"),
        snippet(text, s["start"], s["end"], 80, paged).alias("snippet"), s["confidence"].alias("confidence"),
        S.risk_class(s["type"], s["severity"]).alias("risk"), s["decision"].alias("annotation"),
        (s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"), s["severity"].alias("severity"),
        *([masked.alias("masked_snippet")] if masked is not None else []),
    ]
    names = FINDING_FIELDS + ["severity", "masked_snippet"]
    return F.struct(*[f for f, name in zip(fields, names, strict=False) if wanted is None or name in wanted])


@lru_cache(maxsize=128)
def _found(text: str, profile: str, patterns: tuple[Pattern, ...] | None, _session: int) -> Column:
    """Spans of a text before overlap resolution. Building the expression takes some thousand calls, so it is kept."""
    t, paged = F.col(text), F.col("_pages")
    if profile == "context":
        return scored_features(F.col("_features"))
    if profile == "strict":
        return strict_spans(t, paged)
    return fast_spans(t, patterns or (EXTENDED if profile == "extended" else LIVE), paged)


@lru_cache(maxsize=8)
def _resolved(_session: int) -> Column:
    return resolve_overlaps(F.col("_found"), SPAN)


@lru_cache(maxsize=128)
def _gate(text: str, patterns: tuple[Pattern, ...], _session: int) -> Column | None:
    return doc_gate(patterns, F.col(text))


def with_spans(df: DataFrame, profile: str = "fast", patterns: Sequence[Pattern] | None = None,
               scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """Adds `_spans`, the resolved spans of each text, and `_pages`, which later cuts out of the text can use.

    Steps are projections of their own: a step refers to the one before it more than once, so Spark keeps them apart
    and evaluates each once per row.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    kept = tuple(patterns) if patterns is not None else None
    if profile == "context":
        out = with_context_features(df, text, kept or LIVE, scorer or lexical_scorer)
    else:
        out = df.withColumn("_pages", pages(F.col(text)))
    session = id(SparkContext._gateway)
    out = out.withColumn("_found", _found(text, profile, kept, session))
    return out.withColumn("_spans", _resolved(session)).drop("_found", "_features", "_sentences")


def prepared_chunks(documents: DataFrame, profile: str, patterns: Sequence[Pattern] | None, text: str,
                    filename: str | None, chunk_size: int | None, overlap: int, spread_by: str | None,
                    screen: bool = False) -> DataFrame:
    """Chunked and gated texts: what the expensive expressions run on. `screen` also drops texts by file name, what looks binary (by
    its first 500 characters, and those of each chunk) and, in the strict profile, minified.

    File names are tested below the generator. Text predicates sit above it, on its output, so that a text which is
    itself a computed column is computed once and not once per predicate.
    """
    if screen and filename:
        documents = documents.filter(~is_noise_filename(F.col(filename)))
    t = F.col(text)
    chunks = chunk_documents(documents.filter(t.isNotNull()), chunk_size, overlap, text, spread_by, head=500 if screen else 0)
    keep = ~is_blank(t)
    if screen:
        own = F.substring(t, F.col("lead") + 1, F.lit(500))
        keep = keep & ~is_binary(F.col("head")) & ((F.col("chunk_no") == 0) | ~is_binary(own))
        if profile == "strict":
            keep = keep & ~is_minified(t)
    if profile == "strict":
        gate = any_gate(t, [DIGIT_RUNS, CAPITALS, AT_SIGN])
    else:
        gate = _gate(text, tuple(patterns or (EXTENDED if profile == "extended" else LIVE)), id(SparkContext._gateway))
    return chunks.filter(keep if gate is None else gate & keep).drop("head")


def scan(
    documents: DataFrame, profile: str = "fast", patterns: Sequence[Pattern] | None = None,
    scorer: Scorer | None = None, *, text: str = "text", filename: str | None = "path",
    chunk_size: int | None = None, overlap: int = dims.CHUNK_OVERLAP, spread_by: str | None = None, screen: bool = False,
    keep_severity: bool = False, masked: bool = False, fields: Sequence[str] | None = None,
) -> DataFrame:
    """Scan every document; the other document columns are carried along to each finding.

    Texts are scanned whole. With `chunk_size`, longer ones are cut, and every piece sees `overlap` characters on both sides:
    enough for matches and their context windows, and for sentences up to that length. `screen` leaves out lock files
    and the like (by the column `filename`) and what looks binary or minified, as older scans did. `masked` adds `masked_snippet`, in which no value found in the text can be read: the form
    to store or show. `fields`: the columns of findings that are wanted (default all); others, such as snippets, are not computed.

    Profiles: `fast` (patterns, validators, keyword confidence), `context` (sentence scores from `scorer`, a function
    from a sentence column to a label -> probability map), `extended` (thirteen patterns, full validators), `strict`
    (validator-first). The plan is one stage: filters, one generator, no exchange, no Python worker.
    """
    clash = sorted(set(documents.columns) & {*FINDING_FIELDS, "severity", "chunk_no", "chunk_start", "lead", "masked_snippet"} - {text})
    offered = FINDING_FIELDS + (["severity"] if keep_severity else []) + (["masked_snippet"] if masked else [])
    if unknown := sorted(set(fields or ()) - set(offered)):
        raise ValueError(f"findings have no {unknown}")
    shown_fields = [f for f in offered if fields is None or f in fields]
    if clash:
        raise ValueError(f"rename the document columns {clash}: findings have columns of that name")
    chunks = prepared_chunks(documents, profile, patterns, text, filename, chunk_size, overlap, spread_by, screen)
    t, paged = F.col(text), F.col("_pages")
    chunks = with_spans(chunks, profile, patterns, scorer, text)
    if masked:
        chunks = chunks.withColumn("_spans", F.array_sort("_spans"))
    shown = (lambda i: masked_snippet(t, F.col("_spans"), i, 80, paged)) if masked else (lambda i: None)
    found = F.transform("_spans", lambda s, i: finding_struct(t, s, F.col("chunk_start"), F.col("lead"), paged, shown(i), None if fields is None else [*shown_fields, "start"]))
    if chunk_size is not None and overlap:  # a match belongs to the piece it starts in
        found = F.filter(found, lambda f: (f["start"] >= F.col("chunk_start")) & (f["start"] < F.col("chunk_start") + F.lit(chunk_size)))
    carried = [c for c in documents.columns if c != text]
    # explode_outer: the plain form makes the optimizer add a size() filter that runs the detection a second time
    rows = chunks.select(*carried, F.explode_outer(found).alias("_f")).filter(F.col("_f").isNotNull())
    return rows.select(*carried, *[F.col(f"_f.{f}").alias(f) for f in shown_fields])


def detect(documents: DataFrame, type_name: str, **options) -> DataFrame:
    """A single detector: the findings of one pattern, with its validator and without competition from other types."""
    profile = options.pop("profile", "fast")
    patterns = EXTENDED if profile == "extended" or type_name in ("GSTIN", "UPI", "ABHA") else LIVE
    if patterns is EXTENDED:
        profile = "extended"
    return scan(documents, profile, select_patterns(patterns, type_name), **options)


def extract_spans(documents: DataFrame, patterns: Sequence[Pattern] = LIVE, text: str = "text") -> DataFrame:
    """Raw pattern hits, before any rule: one row per match with ordinal, type, value and offsets."""
    t = F.col(text)

    def build(p: Pattern) -> Column:
        return F.transform(
            match_spans(t, p.regex),
            lambda s: F.struct(F.lit(p.ordinal).alias("ordinal"), F.lit(p.type).alias("type"),
                               s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")),
        )

    kind = "struct<ordinal:int,type:string,value:string,start:int,end:int>"
    carried = [c for c in documents.columns if c != text]
    gate = doc_gate(patterns, t)
    rows = documents if gate is None else documents.filter(gate)
    return (
        rows.select(*carried, F.explode_outer(_gated(t, patterns, build, kind)).alias("_s"))
        .filter(F.col("_s").isNotNull()).select(*carried, "_s.*")
    )


__all__ = ["scan", "detect", "extract_spans", "register_pattern", "select_patterns", "Pattern", "LIVE", "EXTENDED",
           "lexical_scorer", "sentence_spans", "with_spans"]
