"""Context scoring with landed sentences, entities and a batch classifier.

Spans meet sentences in a sweep over ranges of (document, offset). Spans and entities meet in an interval join: positions are cut
into fixed blocks of characters, so it is an equality on (document, block) with the interval test as residue. Either way one long
document spreads over many tasks.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope import dims
from leakscope.functions import scoring as S
from leakscope.functions.spans import resolve_overlaps
from leakscope.functions.text import is_blank, mask, snippet, strip
from leakscope.operators.numbering import checkpointed
from leakscope.operators.scores import KeptScores, classified, with_scores
from leakscope.operators.detect import (
    FINDING_FIELDS, LIVE, Pattern, prepared_chunks, score_feature, sentence_spans, with_context_features,
)

BLOCK = 1024
ENTITY_REACH = 200


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents -> (key, s, e, text), one row per non-empty sentence."""
    return (
        documents.filter(~is_blank(F.col(text)))
        .select(key, F.explode_outer(sentence_spans(F.col(text))).alias("_s")).filter(F.col("_s").isNotNull())
        .select(key, F.col("_s.start").alias("s"), F.col("_s.end").alias("e"), F.col("_s.value").alias("text"))
    )


def _blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence((first / BLOCK).cast("int"), (last / BLOCK).cast("int")))


def _swept(key: str, carried: dict[int, tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a partition by (key, position): spans get the bounds of the last sentence that began before them, if it holds them."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the sentence that is open where a batch begins
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col = {name: batch.column(name) for name in ("_kind", "_s", "_e", "_pos", "_end")}
            if held is None:
                held = carried.get(batch.column("_part")[0].as_py(), (None, -1, -1))
            kind = col["_kind"].to_numpy()
            s, e = (np.append(col[c].fill_null(-1).to_numpy(), held[i]) for i, c in ((1, "_s"), (2, "_e")))
            keys = np.empty(len(kind) + 1, object)
            keys[:-1], keys[-1] = batch.column(key).to_pylist(), held[0]
            last = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))  # -1 is the one that was carried in
            fits = (keys[last] == keys[:-1]) & (s[last] <= col["_pos"].to_numpy()) & (col["_end"].to_numpy() <= e[last]) & (s[last] >= 0)
            held = (keys[last[-1]], int(s[last[-1]]), int(e[last[-1]]))
            out = batch.drop_columns(["_kind", "_part", "_s", "_e", "_pos", "_end"])
            for name, values in (("sentence_start", s), ("sentence_end", e)):
                out = out.append_column(name, pa.array(values[last].astype(np.int32), pa.int32(), mask=~fits))
            yield out.filter(pa.array(kind == 1))

    return sweep


def sentence_offsets(spans: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each span with `sentence_start` and `sentence_end` of the sentence that holds it whole, null when none does (sentences of a
    document are disjoint). sentences: key, s, e; only offsets move.

    Both sides are dealt out by ranges of (document, offset), so a document with very many spans spreads over many tasks, and one pass
    over each part carries the open sentence along. What is open where a part begins is one row per earlier part.
    """
    kind = spans.schema[key].dataType
    names = ["_kind", "_pos", "_end", "_s", "_e"]
    number = lambda *cols: [F.col(c).cast("int").alias(n) if isinstance(c, str) else F.lit(c).cast("int").alias(n) for n, c in zip(names, cols, strict=True)]
    asked = spans.select("*", *number(1, "start", "end", None, None))
    marks = sentences.select(F.col(key).cast(kind).alias(key), *number(0, "s", "e", "s", "e"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    order = [F.col(key), F.col("_pos"), F.col("_kind")]
    placed = checkpointed(both.repartitionByRange(F.col(key), F.col("_pos")).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    ends = placed.groupBy("_part").agg(F.max(F.when(F.col("_kind") == 0, F.struct(key, "_s", "_e"))).alias("last"))  # a row per task
    carried, held = {}, None
    for row in ends.orderBy("_part").collect():
        if held is not None:
            carried[row["_part"]] = held
        held = tuple(row["last"]) if row["last"] is not None else held
    schema = T.StructType([*spans.schema.fields, T.StructField("sentence_start", T.IntegerType()), T.StructField("sentence_end", T.IntegerType())])
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return placed.mapInArrow(_swept(key, carried), nullable)


def sentence_of_span(spans: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each span with the text of the sentence that contains it whole, "" when none does (sentences are disjoint).

    The sentence is found by offsets alone; its text is joined to it by (key, s). Where `sentences` is a table in buckets by these two
    (`sources.layout.land_bucketed`), no text is shuffled.
    """
    offsets = sentence_offsets(spans, sentences.select(key, "s", "e"), key)
    texts = sentences.select(F.col(key).alias("_k"), F.col("s").alias("_s2"), F.col("text").alias("sentence"))
    out = offsets.join(texts, (F.col(key) == F.col("_k")) & (F.col("sentence_start") == F.col("_s2")), "left")
    return out.drop("_k", "_s2", "sentence_start", "sentence_end").withColumn("sentence", F.coalesce("sentence", F.lit("")))


def _reaching(spans: DataFrame, radius: int) -> DataFrame:
    """Spans once per block that their neighbourhood touches (one or two)."""
    lo, hi = F.col("start") - radius, F.col("end") + radius
    return spans.withColumn("_b", _blocks(F.greatest(lo, F.lit(0)), hi))


def _close(entities: DataFrame, key: str, radius: int) -> tuple[DataFrame, Column]:
    placed = entities.select(
        F.col(key).alias("_k"), F.col("label").alias("_label"), F.col("s").alias("_es"), F.col("e").alias("_ee"),
        (F.col("s") / BLOCK).cast("int").alias("_eb"),
    )
    cond = (
        (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_eb"))
        & (F.col("_es") >= F.col("start") - radius) & (F.col("_ee") <= F.col("end") + radius)
    )
    return placed, cond


def entities_near(spans: DataFrame, entities: DataFrame, radius: int = ENTITY_REACH, key: str = "doc_id") -> DataFrame:
    """Spans with the distinct entity labels found within `radius` characters (`labels`, empty when none).

    An entity lies in one block, so a span meets it once; the left join and the regrouping read the spans once.
    """
    placed, cond = _close(entities, key, radius)
    joined = _reaching(spans, radius).join(placed, cond, "left")
    return joined.groupBy(*spans.columns).agg(F.array_sort(F.collect_set("_label")).alias("labels"))


def score_sentences(sentences: DataFrame, scorer: Callable, column: str = "sentence") -> DataFrame:
    """Classify every distinct sentence once: (sentence, scores).

    `scorer` takes and yields pandas frames: in `sentence`, out `sentence` and `scores` (label -> probability).
    """
    distinct = sentences.select(F.col(column).alias("sentence")).filter(~is_blank(F.col("sentence"))).distinct()
    return distinct.mapInPandas(scorer, "sentence string, scores map<string,double>")


def scan_in_context(
    documents: DataFrame, key: str = "doc_id", scorer: Callable | None = None, scores: DataFrame | None = None,
    entities: DataFrame | None = None, patterns: Sequence[Pattern] = LIVE, *, text: str = "text",
    filename: str | None = "path", chunk_size: int | None = None, overlap: int = dims.CHUNK_OVERLAP, keep_severity: bool = False,
    kept: KeptScores | None = None,
) -> DataFrame:
    """The context profile with a batch classifier (or landed sentence scores) and landed entities. With `kept`, sentences that earlier
    runs have classified are looked up, and the others' scores are kept for later ones.

    Only span rows are shuffled, never texts: features are extracted in the scan stage and written once, sentences are
    classified once each, and overlap resolution regroups the spans of one text slice.
    """
    if (scorer is None) == (scores is None):
        raise ValueError("give either a scorer or a table of sentence scores")
    carried = [c for c in documents.columns if c != text]
    t = F.col(text)
    chunks = prepared_chunks(documents, "context", patterns, text, filename, chunk_size, overlap, None)
    features = with_context_features(chunks, text, patterns)
    if chunk_size is not None and overlap:  # a match belongs to the slice it starts in
        own = lambda f: (f["start"] >= F.col("lead")) & (f["start"] < F.col("lead") + chunk_size)
        features = features.withColumn("_features", F.filter("_features", own)).withColumn("chunk_start", F.col("chunk_start") - F.col("lead"))
    row = lambda f: F.struct(
        f.alias("_f"), snippet(t, f["start"], f["end"], 80, F.col("_pages")).alias("snippet"), mask(f["value"]).alias("value_masked"))
    used = F.array_distinct(F.transform("_features", lambda f: f["sentence_key"]))
    texts = F.transform(F.filter("_sentences", lambda x: F.array_contains(used, x["key"])), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("sentence")))
    # read several times from here on: written once, so that the texts are not scanned again for each use
    base = checkpointed(features.select(*carried, "chunk_no", "chunk_start", F.transform("_features", row).alias("_rows"), texts.alias("_texts")))
    rows = base.select(*carried, "chunk_no", "chunk_start", F.explode("_rows").alias("_r")).select(
        *carried, "chunk_no", "_r.*", (F.col("_r._f.start") + F.col("chunk_start")).alias("start"),
        (F.col("_r._f.end") + F.col("chunk_start")).alias("end"), F.col("_r._f.sentence_key").alias("_key"))
    if scorer is not None:
        table = classified(base.select(F.explode("_texts").alias("_x")).select("_x.sentence"), "sentence", scorer, kept)
    else:
        table = scores.select(F.md5("sentence").alias("key"), "scores")
    rows = with_scores(rows, table, "_key")
    if entities is not None:
        span_key = [key, "start", "end"]
        people, cond = _close(entities.filter(F.col("label") == "PERSON"), key, ENTITY_REACH)
        near = _reaching(rows.select(*span_key).distinct(), ENTITY_REACH).join(people, cond, "left_semi")
        rows = rows.join(near.select(*span_key).distinct().withColumn("_person", F.lit(True)), span_key, "left")
    else:
        rows = rows.withColumn("_person", F.lit(False))
    no_scores = F.create_map().cast("map<string,double>")
    scored = rows.withColumn(
        "_s", score_feature(F.col("_f"), F.coalesce("_scores", no_scores), F.coalesce("_person", F.lit(False)))
    ).filter(F.col("_s.severity").isNotNull())
    # one group is one text, or one slice of it
    group = scored.groupBy(key, "chunk_no").agg(
        F.collect_list(F.struct("_s.*", F.struct(*carried, "start", "end", "snippet", "value_masked").alias("_row"))).alias("_g")
    )
    slim = F.transform("_g", lambda x, i: F.struct(*[x[c].alias(c) for c in ("start", "end", "ordinal", "confidence")], i.alias("at")))
    kind = "struct<start:int,end:int,ordinal:int,confidence:decimal(6,3),at:int>"
    picked = group.withColumn("_slim", slim).withColumn("_kept", resolve_overlaps(F.col("_slim"), kind))
    kept = picked.select(F.explode_outer(F.transform("_kept", lambda k: F.get("_g", k["at"]))).alias("_x")).filter(F.col("_x").isNotNull())
    out = kept.select(
        *[F.col(f"_x._row.{c}").alias(c) for c in carried],
        F.col("_x.type").alias("type"), strip(F.col("_x.value")).alias("value"),
        F.col("_x._row.value_masked").alias("value_masked"), F.col("_x._row.snippet").alias("snippet"),
        F.col("_x.confidence").alias("confidence"),
        S.risk_class(F.col("_x.type"), F.col("_x.severity")).alias("risk"), F.col("_x.decision").alias("annotation"),
        F.col("_x._row.start").alias("start"), F.col("_x._row.end").alias("end"), F.col("_x.severity").alias("severity"),
    )
    return out if keep_severity else out.select(*carried, *FINDING_FIELDS)


__all__ = ["split_sentences", "sentence_offsets", "sentence_of_span", "entities_near", "score_sentences", "scan_in_context"]
