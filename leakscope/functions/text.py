"""Small text expressions shared by the operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java needs (?U) for Unicode \d \s \w \b and case folding.
UNI = "(?U)"
UNI_NOCASE = "(?iU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression so that `body` can use it many times while Spark evaluates it once per row."""
    return F.transform(F.array(value), body).getItem(0)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def lookup(mapping: dict, key: Column, default: Column) -> Column:
    """Dictionary look-up with a default, as a constant-folded map literal (no join, no shuffle)."""
    return F.coalesce(F.try_element_at(literal_map(mapping), key), default)


def matches(col: Column, pattern: str, nocase: bool = True) -> Column:
    return col.rlike((UNI_NOCASE if nocase else UNI) + pattern)


def strip(col: Column) -> Column:
    """Trim every kind of white space on both ends (Spark's trim removes blanks only)."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | ~col.rlike(r"(?U)[^\s\x1c-\x1f]")


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\D", "")


PAGE_BITS = 12
PAGE = 1 << PAGE_BITS


def pages(text: Column) -> Column:
    """Overlapping pages of a long text (a short one is its only page).

    Cutting characters out of a string walks it from the start, which adds up when a long text holds many spans. Bound
    once per row with `let`, pages make every cut a short walk.
    """
    return F.when(F.length(text) <= 2 * PAGE, F.array(text)).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(PAGE)), lambda i: F.substring(text, i + 1, F.lit(2 * PAGE)))
    )


def cut(text: Column, first: Column, size: Column, paged: Column | None = None) -> Column:
    """`size` characters from 0-based position `first`."""
    direct = F.substring(text, first + 1, size)
    if paged is None:
        return direct
    at = F.when(F.size(paged) == 1, F.lit(0)).otherwise(F.shiftright(first, PAGE_BITS))
    local = F.substring(F.get(paged, at), first - at * PAGE + 1, size)
    return F.when((F.size(paged) > 1) & (size > PAGE), direct).otherwise(local)


def context(text: Column, start: Column, end: Column, n: int, paged: Column | None = None) -> Column:
    """The characters from n before a span to n after it. Offsets count from 0, the end is exclusive."""
    left = F.greatest(start - F.lit(n), F.lit(0))
    return cut(text, left, end + F.lit(n) - left, paged)


def snippet(text: Column, start: Column, end: Column, n: int = 80, paged: Column | None = None) -> Column:
    return strip(F.replace(context(text, start, end, n, paged), F.lit("\n"), F.lit(" ")))


def mask(col: Column) -> Column:
    """First and last four characters of a long value, the first two of a short one."""
    return let(
        strip(col),
        lambda v: F.when(F.length(v) > 8, F.concat(F.substring(v, 1, 4), F.lit("****"), F.substring(v, -4, 4)))
        .otherwise(F.concat(F.substring(v, 1, 2), F.lit("****"))),
    )


#: Matches are 8 characters long at least, so a window of 80 on both sides touches no more neighbours than this.
NEIGHBOURS = 24


def masked_snippet(text: Column, spans: Column, i: Column, n: int = 80, paged: Column | None = None) -> Column:
    """The snippet of span i with every span that it touches masked, by position. Spans are in the order of the text and
    don't overlap."""
    own = F.get(spans, i)
    first, last = F.greatest(own["start"] - F.lit(n), F.lit(0)), own["end"] + F.lit(n)
    near = F.filter(F.slice(spans, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1)), lambda x: (x["end"] > first) & (x["start"] < last))

    def step(acc: Column, x: Column) -> Column:
        gap = cut(text, acc["at"], F.greatest(x["start"] - acc["at"], F.lit(0)), paged)
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, mask(x["value"])).alias("out"))

    shown = F.aggregate(near, F.struct(first.alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.greatest(last - acc["at"], F.lit(0)), paged)))
    return strip(F.replace(shown, F.lit("\n"), F.lit(" ")))


def html_escape(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def join_non_blank(sep: str, *cols: Column) -> Column:
    """Join the parts that hold something after trimming."""
    parts = [let(strip(c), lambda v: F.when(F.length(v) > 0, v)) for c in cols]
    return F.concat_ws(sep, *parts)


def normalise_handle(col: Column, kind: str) -> Column:
    """Handle or pasted profile address -> bare name, by kind of source."""
    kind = kind.lower().strip()
    value = strip(col)
    if kind == "twitter":
        return strip(F.regexp_replace(value, r"^@+", ""))
    if kind == "forum":
        return strip(F.regexp_replace(col, r"^u/", ""))
    if kind == "professional":
        value = F.regexp_replace(value, r"^/+", "")
        return F.regexp_replace(F.regexp_replace(value, r"^.*linkedin\.com/in/", ""), r"^/+|/+$", "")
    if kind == "channel":
        return F.regexp_replace(value, r"^@", "")
    if kind == "profile_channel":
        return F.regexp_replace(value, r"^@+", "")
    if kind == "profile_forum":
        value = F.regexp_replace(value, r"^@+", "")
    elif kind != "profile_repo_user":
        raise ValueError(f"unknown kind of handle: {kind}")
    return F.element_at(F.split(F.regexp_replace(value, r"/+$", ""), "/"), -1)
