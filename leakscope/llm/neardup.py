"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import LOWER, NO_ID, SPACES, blocks, flat, fresh, mix, rolled, row_key, signed, stored, word_hashes, words

BINS, BANDS, ROWS = 256, 32, 4
#: Star pairs whose sketches agree on less than the wanted similarity by over SLACK / sqrt(d), d the bins that aren't empty, are not
#: compared. By Hoeffding's bound a link falls there in exp(-2 * SLACK ** 2) of all cases, 1 in 2 billion; for d below 17 nothing does.
SLACK = 3.3
#: Members of a bucket that are compared with each other at once, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 4000, 2_000_000
#: So many members are compared pair by pair, more through the postings of their shingles.
FEW = 24
SKETCH = "k_id long, k_hash long, doc_id long, n long, s1 long, s2 long, bands array<long>, sketch binary, bins int"
_EMPTY = np.uint64(2**64 - 1)


# ---------------------------------------------------------------- sketches

def shingle_sets(texts: pa.Array, window: int) -> list[np.ndarray]:
    """For every text the sorted hashes of its distinct shingles of `window` words, A-Z lowered; with fewer words the whole
    sequence is one shingle, without words there is none."""
    buf, off = flat(texts)
    out = []
    for lo, hi in blocks(off):
        b, o = LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        start, end, at = words(b, o, ~SPACES)
        h = word_hashes(b, start, end)
        runs = rolled(h, window)
        for i in range(hi - lo):
            n = at[i + 1] - at[i]
            if n >= window:
                out.append(np.unique(runs[at[i] : at[i + 1] - window + 1]))
            else:
                out.append(mix(rolled(h[at[i] : at[i + 1]], int(n)) + np.uint64(n)) if n else h[:0])
    return out


def one_permutation(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches: bin i holds the smallest hash that begins with i; an empty bin takes the value of the first bin that is not
    empty in a sequence that depends on i alone (optimal densification). Sets must not be empty."""
    out = np.full((len(sets), BINS), _EMPTY)
    for row, s in zip(out, sets, strict=True):
        bins = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        row[bins[first]] = s[first]
    full, missing, t = out != _EMPTY, np.argwhere(out == _EMPTY), 0
    while len(missing):
        t += 1
        donor = (mix(missing[:, 1].astype(np.uint64) * np.uint64(1 << 20) + np.uint64(t)) % np.uint64(BINS)).astype(np.int64)
        ok = full[missing[:, 0], donor]
        out[missing[ok, 0], missing[ok, 1]] = out[missing[ok, 0], donor[ok]]
        missing = missing[~ok]
    return out


def _sketched(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), window)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            sketch = np.zeros((len(sets), BINS), np.uint64)
            if len(some):
                sketch[some] = one_permutation([sets[i] for i in some])
            used = mix(sketch[:, : BANDS * ROWS] + np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(len(sets), BANDS, ROWS)
            bands = mix((used * np.array([1, 3, 5, 7], np.uint64)).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            bytes_ = mix(sketch).astype(np.uint8)
            sums = [[int(f(s).sum(dtype=np.uint64)) for s in sets] for f in (mix, lambda s: mix(s ^ np.uint64(0x5555555555555555)))]
            yield pa.RecordBatch.from_pydict({
                "k_id": batch.column("k_id"), "k_hash": batch.column("k_hash"), "doc_id": batch.column("doc_id"), "n": n,
                "s1": signed(np.array(sums[0], np.uint64)), "s2": signed(np.array(sums[1], np.uint64)),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(signed(bands.ravel()))),
                "sketch": pa.array([r.tobytes() for r in bytes_], pa.binary()),
                "bins": pa.array([len(np.unique(s >> np.uint64(56))) for s in sets], pa.int32()),
            })

    return run


def sketches(documents: DataFrame, window: int) -> DataFrame:
    """One row per document: key, number of shingles, a 128-bit hash of the set, band hashes and the sketch by bytes."""
    rows = documents.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_sketched(window), SKETCH)


def _agreement(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def share(x: pa.Array, y: pa.Array) -> pa.Array:
        both = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS) for c in (x, y)]
        return pa.array((both[0] == both[1]).mean(axis=1))

    return share(a, b)


def _set_bytes(text: Column, window: int) -> Column:
    """The sorted shingle hashes of a text, eight bytes each."""
    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in shingle_sets(texts, window)], pa.binary())

    return packed(text)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _common(a: Column, b: Column) -> Column:
    """The size of the intersection of two sets."""
    @F.arrow_udf("long")
    def size(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([len(np.intersect1d(_set(s), _set(t), assume_unique=True)) for s, t in pairs], pa.int64())

    return size(a, b)


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to rows (node, root): root is the smallest node that can be reached. Alternates the large-star and
    small-star steps, which keep the number of edges and need few rounds; each round's edges are written."""
    edges, before = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(now) == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = tuple(now)


# ---------------------------------------------------------------- operator

def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. Sizes and sketches are looked at first."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bins", "sketch")])
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = F.lit(percent / 100) - F.lit(SLACK) / F.sqrt(F.least("bins_a", "bins_b"))
    near = sized.filter(_agreement(F.col("sketch_a"), F.col("sketch_b")) >= least).select("a", "b", "n_a", "n_b")
    full = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))
    both = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "n_a", "n_b", _common(F.col("set_a"), F.col("set_b")).alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def forest(mine: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, compared on their full sets: as many as join the groups, so fewer than members.

    mine: the part of each member, one or two; with two, pairs of one part are left to that part's own cell.
    """
    n, label, out = np.array([len(x) for x in sets]), groups.copy(), []
    parts = np.unique(mine)

    def join(i: int, j: int) -> None:
        out.append((i, j))
        label[label == label[j]] = label[i]

    def open_to(i: int) -> np.ndarray:
        fits = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        return fits & (mine != mine[i]) if len(parts) == 2 else fits

    if len(sets) <= FEW:
        for i in range(len(sets)):
            for j in np.flatnonzero(open_to(i)):
                if j > i and label[i] != label[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        join(i, j)
        return out
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(shingle, kind="stable")]  # members by shingle
    size = np.bincount(shingle)
    start, first = np.cumsum(size) - size, np.cumsum(n) - n
    for i in np.flatnonzero(mine == parts[0]):
        if not open_to(i).any():
            continue
        own = shingle[first[i] : first[i] + n[i]]
        own = own[size[own] > 1]
        k = size[own]
        at = np.arange(k.sum()) + np.repeat(start[own] - (np.cumsum(k) - k), k)
        both = np.bincount(holder[at], minlength=len(sets))
        for j in np.flatnonzero(open_to(i) & (100 * both >= percent * (n + n[i] - both))):
            if label[i] != label[j]:
                join(i, j)
    return out


def _linked(percent: int):
    """Rows sorted by cell to the links of each cell. One cell at a time is held."""

    def links(cell: list[tuple]) -> list[tuple]:
        if len({r[3:5] for r in cell}) < 2:
            return []
        number: dict[tuple, int] = {}
        groups = np.array([number.setdefault(r[3:5], len(number)) for r in cell])
        found = forest(np.array([r[0] for r in cell]), groups, [_set(r[5]) for r in cell], percent)
        return [(*cell[i][1:3], *cell[j][1:3]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, cell = ("a1", "a2", "b1", "b2"), None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    out += links(cell)
                    key, cell = row[:3], []
                cell.append(row[3:])
            yield batch_of(out)
        yield batch_of(links(cell))

    return run


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different groups: what the stars have missed. rows: bucket, node, root, n.

    In every bucket with several groups all pairs of different groups are compared on their full sets, and a spanning forest of the
    links comes out: refused pairs are no rows, and a bucket has fewer links than members. Buckets beyond BLOCK members or
    BLOCK_SHINGLES are compared in cells of two parts of about that size.
    """
    stats = rows.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("several"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    wanted = F.when(F.col("several"), F.struct("bucket", "parts"))
    # at most BANDS buckets of a member; its set joins it once and goes out with each of them
    members = rows.join(stats, "bucket").groupBy("node", "root").agg(F.collect_list(wanted).alias("of")).filter(F.size("of") > 0)
    each = members.join(sets, "node").select("node", "root", "set", F.explode("of").alias("o")).select("node", "root", "set", "o.*")
    each = each.withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", F.col("node.s1").alias("n1"),
                        F.col("node.s2").alias("n2"), F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2"), "set")
    dealt = cells.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "n1", "n2")
    out = dealt.mapInArrow(_linked(percent), "a1 long, a2 long, b1 long, b2 long")
    node = lambda p: F.struct(F.col(f"{p}1").alias("s1"), F.col(f"{p}2").alias("s2"))
    return out.select(F.greatest(node("a"), node("b")).alias("a"), F.least(node("a"), node("b")).alias("b"))


def near_duplicates(documents: DataFrame, window: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that are linked, directly or over others, by a shingle similarity of at least `percent` / 100.

    One row per document: k_id and k_hash (its key, see `row_key`), doc_id, n (size of its set), c_id and c_hash (key of the
    first document of its group). Equal sets are one class; only classes go on. Classes that share a band are candidates: in
    every bucket, the class that shares most buckets with others is the centre and the others are compared with it, so a
    bucket gives one pair per member. Where members of a bucket still lie in different groups, they are compared with each other on
    their full sets, and only links that join groups come out.

    Null, empty and blank texts have an empty set and a group of their own. Rows that share id and text are one document. A
    null id counts as smaller than any other. An empty table gives no rows. Texts are read whole.
    """
    docs = stored(sketches(documents, window), "sketches")
    key = F.struct("k_id", "k_hash")
    nodes = stored(
        docs.filter("n > 0").groupBy(F.struct("s1", "s2").alias("node")).agg(F.min(key).alias("first"), *[F.first(c).alias(c) for c in ("n", "bins", "bands", "sketch")]),
        "classes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = stored(members.join(shared, "bucket"), "buckets")
    degree = rows.groupBy("node").agg(F.sum("m").alias("degree"))
    weighed = rows.select("bucket", "node").join(degree, "node")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
    star = rows.join(centres, "bucket").filter("node != centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    star = stored(star, "stars")

    wanted = degree.join(nodes.select("node", "first"), "node").select("node", "first.k_id", "first.k_hash")
    source = documents.select(*row_key(), "text")
    texts = source.join(wanted, ["k_id", "k_hash"]).dropDuplicates(["node"])
    sets = stored(texts.select("node", _set_bytes(F.coalesce("text", F.lit("")), window).alias("set")), "sets")

    links = stored(_verified(star, nodes, sets, percent), "links")
    root = stored(components(links), "roots")
    placed = rows.select("bucket", "node", "n").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stored(_rest(stored(placed, "placed"), sets, percent), "links")
    if not more.isEmpty():
        root = stored(components(links.unionAll(more)), "roots")

    classes = nodes.select("node", "first").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = classes.groupBy("root").agg(F.min("first").alias("group"))
    grouped = classes.join(first, "root").select("node", "group")
    out = docs.select("k_id", "k_hash", "doc_id", "n", F.when(F.col("n") > 0, F.struct("s1", "s2")).alias("node")).join(grouped, "node", "left")
    group = F.coalesce("group", key)
    return out.select("k_id", "k_hash", "doc_id", "n", group["k_id"].alias("c_id"), group["k_hash"].alias("c_hash"))


def duplicate_report(documents: DataFrame, window: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group; null where that row has none), kept (doc_id is component_id)."""
    out = near_duplicates(documents, window, percent)
    component = F.when(F.col("c_id") != NO_ID, F.col("c_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(documents: DataFrame, window: int = 5, percent: int = 80) -> DataFrame:
    """The first document of every group, with all its columns. Rows that share id and text leave one."""
    found = near_duplicates(documents, window, percent)
    names = {k: fresh(documents, k) for k in ("k_id", "k_hash")}
    kept = found.filter("k_id = c_id and k_hash = c_hash").select("k_id", "k_hash").withColumnsRenamed(names).distinct()
    keyed = documents.select("*", *[c.alias(n) for c, n in zip(row_key(), names.values(), strict=True)])
    return keyed.join(kept, list(names.values())).dropDuplicates(list(names.values())).select(*[F.col(f"`{c}`") for c in documents.columns])
