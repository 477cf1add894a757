"""Span arrays: where a pattern matches, and which of several overlapping spans is kept.

Everything here works on one row at a time, so detection needs no shuffle and the same expressions serve streams.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.text import UNI, let

PIECE_TYPE = "array<struct<start:int,end:int,value:string>>"
BLOCK = 64


def _fold(values: Column, init: Column, merge) -> Column:
    return F.aggregate(values, init, merge)


def _running(values: Column, init: Column, merge) -> Column:
    """Fold of all values up to and including each one, for an associative merge.

    Values are folded in blocks, then over the block results, so the work per value is bounded by the block size and
    no array grows inside a fold (a growing accumulator would be copied at every step).
    """

    def inside(block: Column, base: Column) -> Column:
        return F.transform(block, lambda v, i: _fold(F.slice(block, F.lit(1), i + 1), base, merge))

    def in_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        sums = F.transform(starts, lambda at: _fold(F.slice(v, at, F.lit(BLOCK)), init, merge))
        return let(sums, lambda done: F.flatten(F.transform(done, lambda _s, j: let(
            _fold(F.slice(done, F.lit(1), j), init, merge), lambda base: inside(F.slice(v, j * BLOCK + 1, F.lit(BLOCK)), base)))))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, inside(v, init)).otherwise(in_blocks(v)))


def running_sums(values: Column) -> Column:
    return _running(values, F.lit(0), lambda acc, v: acc + v)


def running_max(values: Column) -> Column:
    return _running(values, F.lit(0), lambda acc, v: F.greatest(acc, v))


def _piece(start: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def match_spans(text: Column, pattern: str, flags: str = UNI) -> Column:
    """All non-overlapping matches with 0-based start and exclusive end.

    The text between matches comes from `split` with the same pattern; a match starts after all pieces and matches
    before it. The second regex pass runs only for rows that have a match at all. `split` compiles its pattern for every row and
    the sums are a fold, so the only match of an ASCII text, where UTF-16 units are characters, is located by `regexp_instr`.
    """
    regex = flags + pattern
    ascii_only = F.octet_length(text) == F.length(text)

    def locate(found: Column) -> Column:
        def with_pieces(between: Column) -> Column:
            steps = F.transform(found, lambda v, i: F.length(F.get(between, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))
            return let(running_sums(steps), lambda starts: F.transform(found, lambda v, i: _piece(F.get(starts, i), v)))

        only = F.get(found, F.lit(0))
        alone = (F.size(found) == 1) & ascii_only & (F.length(only) > 0)
        return F.when(alone, F.array(_piece(F.regexp_instr(text, F.lit(regex)) - 1, only))).when(
            F.size(found) > 0, let(F.split(text, regex, -1), with_pieces)).otherwise(F.array().cast(PIECE_TYPE))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), locate)


def between_spans(text: Column, separator: str, flags: str = UNI) -> Column:
    """The pieces between matches of a separator, with their offsets. Empty pieces are dropped."""
    regex = flags + separator

    def with_seps(seps: Column) -> Column:
        def with_pieces(parts: Column) -> Column:
            # a piece ends where the pieces and separators up to it end
            steps = F.transform(parts, lambda v, i: F.length(v) + F.coalesce(F.length(F.get(seps, i - 1)), F.lit(0)))
            located = let(running_sums(steps), lambda ends: F.transform(parts, lambda v, i: _piece(F.get(ends, i) - F.length(v), v)))
            return F.filter(located, lambda p: p["end"] > p["start"])

        whole = F.array(_piece(F.lit(0), text))  # nothing to cut at
        return F.when(F.size(seps) == 0, F.filter(whole, lambda p: p["end"] > p["start"])).otherwise(let(F.split(text, regex, -1), with_pieces))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), with_seps)


def holder(pieces: Column, s: Column) -> Column:
    """The piece that contains span s whole, or null. `pieces` are blocks of sorted, disjoint pieces (see `blocked`)."""
    inside = lambda x: (x["start"] <= s["start"]) & (s["end"] <= x["end"])
    block = F.get(
        F.filter(pieces, lambda b: (F.get(b, F.lit(0))["start"] <= s["start"]) & (s["end"] <= F.element_at(b, -1)["end"])), F.lit(0)
    )
    return F.get(F.filter(block, inside), F.lit(0))


def blocked(values: Column) -> Column:
    """Array of blocks of an array, for two-step look-ups."""
    return let(values, lambda v: F.when(F.size(v) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda at: F.slice(v, at, F.lit(BLOCK)))))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _before(a: Column, b: Column) -> Column:
    """Comparator for keeping order: confidence descending, pattern position, start."""
    return (
        F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1)
        .when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    )


def _greedy(cluster: Column, element_type: str) -> Column:
    ranked = F.array_sort(cluster, _before)
    return F.aggregate(
        ranked,
        F.array().cast(f"array<{element_type}>"),
        lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))),
    )


def resolve_overlaps(spans: Column, element_type: str) -> Column:
    """Keep a span only if it overlaps no better one.

    Spans are first cut into runs that touch each other (a sweep over start order), then the greedy choice is made
    inside each run. Runs are a handful of spans, so a text with many thousand matches stays close to linear.
    `element_type` is the SQL type of one span; its first field must be start, and end, ordinal, confidence must exist.
    """

    def closed(run: Column) -> Column:
        return F.when(F.size(run) <= 1, run).otherwise(_greedy(run, element_type))

    def sweep(ordered: Column) -> Column:
        def runs(reach: Column) -> Column:
            first = F.filter(
                F.sequence(F.lit(0), F.size(ordered) - 1),
                lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(reach, i - 1)),
            )
            return let(first, lambda at: F.flatten(F.transform(at, lambda f, j: closed(
                F.slice(ordered, f + 1, F.coalesce(F.get(at, j + 1), F.size(ordered)) - f)))))

        # where no span reaches into the next one, every run is one span
        apart = F.forall(F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: F.get(ordered, i)["start"] >= F.get(ordered, i - 1)["end"])
        return F.when(apart, ordered).otherwise(let(running_max(F.transform(ordered, lambda s: s["end"])), runs))

    # natural order of the struct is start order
    return F.when(F.size(spans) <= 1, spans).otherwise(let(F.array_sort(spans), sweep))
