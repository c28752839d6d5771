"""Quality classifier: histogram gradient-boosted trees over document statistics.

A bounded sample of labelled rows (``SAMPLE_ROWS``, those whose identifiers hash lowest) is turned
into statistics by the tasks; the few numbers per row are fitted on the driver: features are cut at
quantiles of the sample, every level of a tree is found from gradient histograms, and each tree is a
complete binary tree in three arrays. Scoring walks all rows of a batch down all trees at once, one
array step per level, in the tasks that read the texts; every document is scored on its whole text.

Statistics come from the text alone. Null texts are empty, and empty texts are scored like others.
Labels: null ones are left out; of several for a document the mean counts, 0.5 as 1. Without labels
of both kinds the score is the share of label 1 (0.5 without any). Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aestudy.llm.common import in_fold, keyed_texts

#: Most labelled rows that a model learns from.
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3

FEATURES = [
    "log_words", "word_length", "longest_word", "distinct_words", "top_word", "distinct_triples", "log_lines", "line_length",
    "repeated_lines", "upper", "digits", "symbols", "bars", "shouts", "stops", "brackets", "other_letters", "short_words",
]


def byte_mask(letters: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(letters)] = True
    return mask


UPPER = byte_mask(bytes(range(65, 91)))
DIGITS = byte_mask(b"0123456789")
SYMBOLS = byte_mask(b"#*$%&~^@=+_")
BRACKETS = byte_mask(b"<>{}[]()")


def statistics(text: bytes) -> list[float]:
    """The features of a UTF-8 text, in the order of ``FEATURES``."""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    per = max(1, n)
    frequent = Counter(words).most_common(1)[0][1] / n if n else 0.0
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    return [
        np.log1p(n),
        float(lengths.mean()) if n else 0.0,
        float(lengths.max()) if n else 0.0,
        len(set(words)) / per,
        frequent,
        triples,
        np.log1p(len(lines)),
        n / max(1, len(lines)),
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        counts[UPPER].sum() / size,
        counts[DIGITS].sum() / size,
        counts[SYMBOLS].sum() / size,
        counts[ord("|")] / per,
        counts[ord("!")] / per,
        (counts[ord(".")] + counts[ord(",")]) / per,
        counts[BRACKETS].sum() / size,
        counts[128:].sum() / size,
        float((lengths <= 3).mean()) if n else 0.0,
    ]


@dataclass
class FlatTrees:
    """Complete trees of one depth in arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(rows), self.base)
        inner = self.feature.shape[1]
        at = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smoothing: float = 1.0,
    least: float = 5.0,
) -> FlatTrees:
    """Logistic boosting on histograms; ``least`` is the smallest hessian of a child."""
    n, width = rows.shape if rows.size else (0, len(FEATURES))
    inner, leaves = (1 << depth) - 1, 1 << depth
    positive = float(labels.sum())
    share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    if not n or positive in (0.0, float(n)):
        return FlatTrees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(rows[:, j], np.arange(1, bins) / bins)) for j in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(n, base)
    features = np.zeros((trees, inner), dtype=np.int64)
    thresholds = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = p - labels, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for j in range(width):
                key = (node - first) * bins + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smoothing) + (gt - gs) ** 2 / (ht - hs + smoothing) - gt**2 / (ht + smoothing)
                gain[(hs < least) | (ht - hs < least)] = 0.0
                gain[:, len(cuts[j]) :] = 0.0
                place = gain.argmax(axis=1)
                found = gain[np.arange(count), place]
                better = np.flatnonzero(found > best + 1e-12)
                best[better] = found[better]
                features[t, first + better] = j
                thresholds[t, first + better] = cuts[j][place[better]]
            node = 2 * node + 1 + (rows[np.arange(n), features[t][node]] > thresholds[t][node])
        at = node - inner
        gs, hs = (np.bincount(at, weights=w, minlength=leaves) for w in (g, h))
        leaf[t] = -rate * gs / (hs + smoothing)
        score += leaf[t][at]
    return FlatTrees(features, thresholds, leaf, base)


def table_of(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts.cast(pa.binary())]
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = FOLDS,
    sample_rows: int = SAMPLE_ROWS,
    **options,
) -> FlatTrees:
    """Learn from at most ``sample_rows`` labelled documents outside the held-out fold.

    Of rows with one identifier, the one with the smallest statistics counts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.where(~in_fold(F.col("doc_id"), folds)).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = keyed_texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = table_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(list(values), pa.list_(pa.float64()))], names=["doc_id", "label", "values"])

    described = rows.mapInArrow(describe, "doc_id string, label double, values array<double>")
    found = sorted(map(tuple, described.groupBy("doc_id", "label").agg(F.min("values").alias("values")).collect()))
    values = np.array([v for _, _, v in found], dtype=float).reshape(-1, len(FEATURES))
    return fit_trees(values, np.array([y for _, y, _ in found], dtype=float), **options)


def score_quality(docs: DataFrame, model: FlatTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, one row per row of ``docs``."""
    rows = keyed_texts(docs, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(table_of(batch.column(1))))], names=["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: FlatTrees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).fill_null("")
            yield batch.filter(pa.array(model.score(table_of(texts)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
