"""Mixing sources to target weights by Poisson replication."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import fresh

#: The distribution is inverted term by term from exp(-rate), which must not vanish: a rate beyond this is drawn as the sum of
#: equal parts. Where the caller asks for a `size`, it is refused.
MAX_RATE = 500.0
#: A table with a rate for each source is broadcast up to so many sources, else joined by a shuffle.
BROADCAST_SOURCES = 10_000
_BITS = 52


def uniform(doc_id: Column, seed: int, part: Column | None = None) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed, part and id: the same on every run and engine."""
    head = F.lit(f"{seed}:") if part is None else F.concat(F.lit(f"{seed}/"), part.cast("string"), F.lit(":"))
    text = F.concat(head, F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**_BITS))


def cumulative(rate: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ... until the tail is below the resolution of `uniform`."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    none = F.array().cast("array<double>")

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, F.exp(-rate)).otherwise(acc["term"] * rate / k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), F.concat(acc["all"], F.array(acc["total"] + term)).alias("all"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), none.alias("all"))
    return F.aggregate(F.sequence(F.lit(0), last), start, step)["all"]


def copies(u: Column, cdf: Column) -> Column:
    """The inverse distribution: how many of its steps lie at or below u."""
    return F.size(F.filter(cdf, lambda p: p <= u))


def parts(rate: Column) -> Column:
    """So many equal parts of the rate are drawn one by one."""
    return F.greatest(F.ceil(rate / MAX_RATE), F.lit(1)).cast("int")


def draws(doc_id: Column, seed: int, cdf: Column, n: Column) -> Column:
    """The sum of n independent draws. The first is the only one of a rate up to MAX_RATE."""
    first = copies(uniform(doc_id, seed), cdf)
    more = F.aggregate(F.sequence(F.lit(2), n), F.lit(0), lambda acc, part: acc + copies(uniform(doc_id, seed, part), cdf))
    return first + F.when(n > 1, more).otherwise(0)


def source_rates(documents: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5,
                 size: float | None = None, source: str = "source") -> DataFrame:
    """Every source with its number of documents and the mean number of copies that brings its share to its target.

    weights: target weight by source, any positive scale; sources that aren't listed get none. Without weights, the target
    of a source is its number of documents to the power `temperature`. size: expected rows of the mix, by default the rows
    of the input. A null source is a source of its own. Counts are combined before the shuffle. With `size`, a rate over
    MAX_RATE is an error.
    """
    counts = documents.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        target = F.pow(F.col("n_docs").cast("double"), F.lit(temperature))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    weighed = counts.withColumn("target", target)
    total = weighed.agg(F.sum("target").alias("all_target"), F.sum("n_docs").alias("all_docs"))
    wanted = F.col("all_docs").cast("double") if size is None else F.lit(float(size))
    rate = F.when(F.col("all_target") > 0, F.col("target") / F.col("all_target") * wanted / F.col("n_docs")).otherwise(0.0)
    rated = weighed.join(F.broadcast(total)).withColumn("rate", rate)  # one row
    if size is None:
        return rated.select("source", "n_docs", "rate")
    checked = F.when(F.col("rate") > MAX_RATE, F.raise_error(F.concat(F.lit("rate over the limit for "), F.coalesce("source", F.lit("null")))))
    return rated.withColumn("rate", F.coalesce(checked.cast("double"), F.col("rate"))).select("source", "n_docs", "rate")


def mix_sources(documents: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5,
                size: float | None = None, seed: int = 42, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Every document as often as a Poisson draw with its source's rate says, in random order.

    Adds `copy` (from 1) to the columns. The draw depends on seed and id alone, so a repeated or retried run gives the same
    rows; rows that share an id draw alike, a null id counts as the text ''. Copies are dealt out by a hash of seed, id and
    copy and sorted by it within each partition: a global shuffle in one exchange, even for one hot source. A source with
    target 0 leaves; an empty table stays empty. If `copy` is taken, the new column is copy_ and so on.
    """
    rates = source_rates(documents, weights, temperature, size, source).select("source", cumulative(F.col("rate") / parts(F.col("rate"))).alias("cdf"), parts(F.col("rate")).alias("parts"))
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    names = {k: fresh(documents, k) for k in ("m_source", "m_cdf", "m_parts", "copy", "m_order")}
    rates = rates.withColumnsRenamed({"source": names["m_source"], "cdf": names["m_cdf"], "parts": names["m_parts"]})
    on = F.col(source).eqNullSafe(F.col(names["m_source"]))
    drawn = documents.join(F.broadcast(rates) if small else rates, on)
    n = draws(F.col(doc_id), seed, F.col(names["m_cdf"]), F.col(names["m_parts"]))
    each = drawn.filter(n > 0).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), n))).drop(names["m_source"], names["m_cdf"], names["m_parts"])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col(doc_id).cast("string"), F.col(names["copy"]).cast("string")).cast("binary"))
    dealt = each.withColumn(names["m_order"], order)
    return dealt.repartition(names["m_order"]).sortWithinPartitions(names["m_order"]).drop(names["m_order"])
