"""Source divergence audit: how far the sources of a language differ from each other and from the language, term by term.

Terms are counted with a translate table, bytes.split and a Counter for each document, and leave a task as sums. Shares are
integers in units of one in a billion, so all results are exact.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.common import stored

#: Bytes that are no part of a term become a blank, A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Sums that a task holds before it puts them out.
HELD = 250_000
#: Kept terms per task where pairs of sources are compared.
TERMS_PER_TASK = 20_000
#: Copies of the table of groups that terms are joined to, so that a hot group's terms spread over as many tasks.
SALTS = 32
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(text: str, piece: int = 1 << 20) -> Counter[bytes]:
    """How often each term stands in a text. A long text is split a stretch at a time."""
    raw = text.encode().translate(TERM_BYTES)
    if len(raw) <= piece:
        return Counter(raw.split())
    out, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + piece)
        end = len(raw) if end < 0 else end
        out.update(raw[at:end].split())
        at = end
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over (lang, source, term); a row without a term for each group met."""
    sums: dict[tuple[str, str], tuple[dict[bytes, int], Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in sums.items():
            terms = [None, *(t.decode() for t in n)]
            columns = {"lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()),
                       "term": pa.array(terms, pa.string()), "n": pa.array([0, *n.values()], pa.int64()),
                       "docs": pa.array([0, *(docs[t] for t in n)], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)
        sums.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, docs = sums.setdefault((lang.as_py() or "", source.as_py() or ""), ({}, Counter()))
            found, before = term_counts(text.as_py() or ""), len(n)
            for term, k in found.items():
                n[term] = n.get(term, 0) + k
            docs.update(found.keys())
            held += len(n) - before
            if held >= HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def group_counts(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row with a null term for every group."""
    rows = documents.select(*(F.col(c).cast("string") for c in (lang, source, text)))
    return rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, n, and `by` with (source, n) for every source that has the term, for terms in so many documents of the language."""
    by = F.collect_list(F.struct("source", "n"))  # one entry for each source of the language
    terms = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
    return terms.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), by.alias("by")).filter(F.col("docs") >= min_documents).drop("docs")


def groups_of(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs: its number within the language, n_group and n_lang (occurrences of kept terms), v (kept terms)."""
    present = counts.filter(F.col("term").isNull()).select("lang", "source")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("v"))
    each = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("n_group"))
    groups = present.join(each, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "n_lang", "v"])
    return groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total), exact for any counts."""
    scaled = (n.cast("decimal(19,0)") + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.call_function("div", scaled, total.cast("decimal(20,0)")) + 1).cast("long")


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """The same for arrays: three digits at a time, so 64 bits are enough for totals up to 9e15."""
    rest, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the distances of all ordered pairs of a language's sources."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i in range(0, len(langs), 512):
            part = batch.slice(i, 512)
            rows = zip(part.column("lang"), part.column("numbers"), part.column("ns"), strict=True)
            of: dict[str, list[tuple]] = {}
            for k, (lang, numbers, ns) in enumerate(rows):
                of.setdefault(lang.as_py(), []).append((k, numbers.values.to_numpy(), ns.values.to_numpy()))
            for lang, terms in of.items():
                totals = part.column("totals")[terms[0][0]].values.to_numpy()
                n = np.zeros((len(terms), len(totals)), np.int64)
                for row, (_, numbers, ns) in enumerate(terms):
                    n[row, numbers] = ns
                p = shares(n, totals)
                total = sums.setdefault(lang, np.zeros((len(totals), len(totals)), np.int64))
                for other in range(len(totals)):
                    total[:, other] += distances(p, p[:, other : other + 1]).sum(axis=0)
    for lang, total in sums.items():
        a, b = np.nonzero(total)
        for i in range(0, len(a), 10_000):
            x, y = a[i : i + 10_000], b[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(x), pa.string()), "number": pa.array(x, pa.int64()),
                                              "other": pa.array(y, pa.int64()), "value": pa.array(total[x, y], pa.int64())})


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")


def source_divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the pairs of sources of each language, and the terms that mark a source.

    A language keeps the terms in at least min_documents of its documents. A group's share of a term is p = 1 + floor(10^9 * (count
    + 1) / (N + V)), with N occurrences of V kept terms. Part `pair` has every other source of the language with the sum of
    floor((p - q)^2 / q) over all kept terms, part `term` the `top` terms that the group has and that stand above their share in the
    language, with that value. Ranks go by value, then by item in UTF-8.

    Null lang, source and text are ''. Repeated rows count as often as they occur. A group without terms is a group like others, a
    language without kept terms has pairs of value 0, an empty table no rows. Other columns are not looked at.

    Text is read once and leaves a task as sums, so a frequent term is one row per task and group; a language's pairs of
    sources are as many as the result has. Sums of pairs are made in numpy over all kept terms, without a row per term and pair.
    """
    counts = stored(group_counts(documents), "group_counts")
    kept = stored(kept_terms(counts, min_documents), "kept_terms")
    groups = stored(groups_of(counts, kept), "groups")

    # terms
    entries = kept.select("lang", "term", "n", F.explode("by").alias("b")).select("lang", "term", "n", F.col("b.source").alias("source"), F.col("b.n").alias("k"))
    placed = entries.withColumn("salt", _salt()).join(_salted(groups), ["lang", "source", "salt"])
    p, q = share(F.col("k"), F.col("n_group") + F.col("v")), share(F.col("n"), F.col("n_lang") + F.col("v"))
    above = placed.select("lang", "source", "term", p.alias("p"), q.alias("q"), "number").filter((F.col("k") > 0) & (F.col("p") > F.col("q")))
    value = F.expr("(p - q) * (p - q) div q")
    terms = _ranked(above.select("lang", "source", F.col("term").alias("item"), value.alias("value")), "term", top)

    # pairs
    totals = F.sort_array(F.collect_list(F.struct("source", (F.col("n_group") + F.col("v")).alias("total"))))
    langs = groups.groupBy("lang").agg(F.transform(totals, lambda g: g["total"]).alias("totals"), F.transform(totals, lambda g: g["source"]).alias("sources"))
    numbers = F.transform("by", lambda b: F.array_position("sources", b["source"]) - 1)
    rows = kept.withColumn("salt", _salt()).join(_salted(langs), ["lang", "salt"])
    tasks = -(-kept.count() // TERMS_PER_TASK) or 1
    dense = rows.select("lang", numbers.alias("numbers"), F.transform("by", lambda b: b["n"]).alias("ns"), "totals").repartition(tasks)
    sums = dense.mapInArrow(_compared, "lang string, number long, other long, value long").groupBy("lang", "number", "other").agg(F.sum("value").alias("value"))
    one, two = groups.select("lang", "source", "number"), groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    every = one.join(two, "lang").filter(F.col("number") != F.col("other"))  # the rows of the result
    pairs = every.join(sums, ["lang", "number", "other"], "left").fillna(0, ["value"])
    return _ranked(pairs, "pair", None).unionByName(terms)
