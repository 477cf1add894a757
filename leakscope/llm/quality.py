"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for numpy traversal."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import SPACES, blocks, byte_classes, flat, fresh, word_hashes, words

#: At most so many labelled rows are used to fit; they are the ones with the smallest hash of their id.
MAX_TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "bar", "punct", "space", "non_ascii", "control",
    "lines_per_word", "words_per_line", "short_line", "repeat_word", "repeat_line", "distinct_words", "symbol_ends", "caps_words",
    "lone_symbols", "top_word",
)
_UPPER, _LOWER, _DIGIT = byte_classes((65, 90)), byte_classes((97, 122)), byte_classes((48, 57))
_PUNCT = byte_classes((0x2C, 0x2E), (0x3A, 0x3B), (0x21, 0x22), (0x27, 0x29), (0x3F, 0x3F))
_ALNUM = byte_classes((48, 57), (65, 90), (97, 122), (128, 255))
_CONTROL = byte_classes((0, 8), (14, 31), (127, 127))
_SYMBOL = ~(_ALNUM | _PUNCT | _CONTROL | SPACES)
_MARK = _SYMBOL | byte_classes((0x21, 0x21))


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _block_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n_bytes = np.diff(off).astype(np.float64)
    start, end, at = words(buf, off, ~SPACES)
    n_words, size = np.diff(at).astype(np.float64), (end - start).astype(np.float64)
    mean = _share(_per_row(size, at), n_words)
    h = word_hashes(buf, start, end)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    runs = np.flatnonzero(new)
    top = np.zeros(len(off) - 1)
    np.maximum.at(top, row[order][runs], np.diff(np.append(runs, len(h))))

    line_start, line_end, line_at = words(buf, off, ~byte_classes((10, 10)))
    n_lines, line_size = np.diff(line_at).astype(np.float64), line_end - line_start
    lh, line_row = word_hashes(buf, line_start, line_end), np.repeat(np.arange(len(off) - 1), np.diff(line_at))
    order = np.lexsort((lh, line_row))
    again = np.zeros(len(lh))
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])

    first, last = buf[start] if len(start) else buf[:0], buf[end - 1] if len(end) else buf[:0]
    caps = np.zeros(len(start))
    if len(start):
        upper, lower = (np.add.reduceat(t[buf], start, dtype=np.int32) for t in (_UPPER, _LOWER))
        caps = (upper > 1) & (lower == 0)
    n_rows = len(off) - 1
    cell = np.repeat(np.arange(n_rows, dtype=np.int32) << 8, np.diff(off)) | buf
    histogram = np.bincount(cell, minlength=n_rows * 256).reshape(n_rows, 256).astype(np.float64)
    of = lambda table: _share(histogram @ table, n_bytes)
    return np.stack([
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(_share(_per_row(size**2, at), n_words) - mean**2, 0)),
        of(_UPPER), of(_DIGIT), of(_SYMBOL), of(byte_classes((0x7C, 0x7C))), of(_PUNCT), of(SPACES), of(byte_classes((128, 255))), of(_CONTROL),
        _share(n_lines, n_words), _share(n_words, n_lines), _share(_per_row(line_size < 20, line_at), n_lines),
        _share(_per_row(same, at), n_words), _share(_per_row(again, line_at), n_lines), _share(_per_row(new, at), n_words),
        _share(_per_row(_MARK[last], at), n_words), _share(_per_row(caps, at), n_words),
        _share(_per_row((size == 1) & _SYMBOL[first], at), n_words), _share(top, n_words),
    ], axis=1).astype(np.float32)


def features(texts: pa.Array) -> np.ndarray:
    """The statistics of whole texts, a row each; null and empty texts have zeros."""
    buf, off = flat(texts)
    parts = [_block_features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in blocks(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    return of(text)


# ---------------------------------------------------------------- trees

@dataclass
class Forest:
    """Trees of equal depth as arrays: node i of a tree has the children 2i+1 and 2i+2, leaves come last. A node that was
    not split sends all rows to the left (its threshold is infinite)."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: every level of every tree is one gather over all rows."""
        total, inner = np.full(len(x), self.base), self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
               ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic boosting: every level of a tree is grown from one histogram of gradients per node, feature and bin.
    Classes weigh the same. Without rows, or with one class, the forest is a constant."""
    inner, leaves, d = 2**depth - 1, 2**depth, x.shape[1]
    positive = float(y.sum())
    if not 0 < positive < len(y):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0 if not len(y) else 4.0 if positive else -4.0, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # x > cut k means bin > k
    weight = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
    raw, out_f, out_t, out_l = np.zeros(len(y)), [], [], []
    flat_bin = binned + np.arange(d) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, n = 2**level - 1, 2**level
            cell = ((node - lo)[:, None] * (d * bins) + flat_bin).ravel()
            gs = np.bincount(cell, np.repeat(g, d), n * d * bins).reshape(n, d, bins).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, d), n * d * bins).reshape(n, d, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = -1
            best = gain.reshape(n, -1).argmax(1)
            for k in range(n):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[lo + k], threshold[lo + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += leaf[at]
        out_f.append(feature), out_t.append(threshold), out_l.append(leaf)
    return Forest(np.stack(out_f), np.stack(out_t), np.stack(out_l), 0.0, depth)


# ---------------------------------------------------------------- operator

def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Features and label of at most `limit` labelled documents outside the held-out fold, those with the smallest hash of
    their id. The chosen labels are bounded by `limit`, so they are broadcast to the scan of the documents. Of rows that share an id the
    text with the smallest hash counts, so a fit doesn't depend on the run."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = picked.select("doc_id", "y", feature_column(F.col("text")).alias("x"), F.xxhash64("text").alias("h"))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("x", "h").alias("x"))


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_ROWS, **shape) -> Forest:
    """Fit on the bounded sample that `training_rows` chooses."""
    rows = training_rows(documents, labels, label, limit).toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return fit_forest(x, rows["y"].to_numpy().astype(np.float64), **shape)


def quality_score(text: Column, forest: Forest) -> Column:
    """Probability that the text is good; null and empty texts are scored by their zeros."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.predict(features(texts)))

    return score(text)


def score_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score in 0..1, predicted (1 from 0.5). One narrow stage after the fit.

    Texts are scored whole. Null and empty texts get the score of zero statistics. Repeated rows each get their row. Other
    columns of the documents are never read. Without usable labels every score is 0.5.
    """
    forest = fit_quality(documents, labels, label, limit)
    rows = documents.select("doc_id", quality_score(F.col("text"), forest).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns."""
    forest = fit_quality(documents, labels, label, limit)
    name = fresh(documents, "score")
    return documents.withColumn(name, quality_score(F.col("text"), forest)).filter(F.col(name) >= 0.5).drop(name)
