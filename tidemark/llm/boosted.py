"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE``, those of smallest hash), whose statistics are
put into at most ``BINS`` bins; every level of a tree is grown from one gradient histogram per feature. Trees are kept
as flat arrays (feature, threshold, value; node k has children 2k + 1 and 2k + 2), so that a batch of documents walks
all trees at once with numpy. Scores come from one pass over the texts, without a shuffle.

Defined cases: a null or empty text has zero statistics and gets a score like any other. Null labels, and labels of
documents that do not exist, are not used; a document labelled more than once counts once per label. Without usable
labels every score is 0.5; with labels of one class only, it is the smoothed share of that class. Rows with a null id
are scored, and are neither held out nor used for fitting. Other columns pass through; columns of the input called like
the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.stats import COUNTS, text_counts

SAMPLE = 20_000  # labelled rows at most that the trees are fitted on
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
L2 = 5.0
FOLDS = 5
CUTOFF = 0.3


def features(counts: pd.DataFrame) -> np.ndarray:
    """Length and shares; shares of short texts are drawn towards zero by a pseudo-count."""
    c = {n: counts[n].to_numpy(float) for n in COUNTS}
    words, chars, lines = c["n_words"] + 1, c["n_chars"] + 1, c["n_lines"] + 1
    per_word = [c[n] / (words + 5) for n in ("n_symbols", "n_marks", "n_digits", "n_bars", "n_repeat_words", "adjacent")]
    return np.column_stack([
        np.log(words), c["word_chars"] / words, c["n_distinct"] / words ** 0.9, c["n_upper"] / (chars + 20), c["n_dup_lines"] / lines,
        words / lines, c["longest_word"], (c["n_chars"] - c["word_chars"]) / chars, *per_word])


@dataclass
class Trees:
    """Flat arrays of shape (trees, nodes); a leaf reached early repeats its value below."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; splits by the gain of the gradient histograms."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return none
    share = (y.sum() + 1) / (len(y) + 2)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)])  # bin b: value <= edge b
    n, d = x.shape
    raw = np.full(n, none.base)
    trees = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), none.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2 ** level - 1, 2 ** level
            at = node - first
            best = np.full(wide, 1e-6)
            for f in range(d):
                cell = at * BINS + binned[:, f]
                gs = np.bincount(cell, g, wide * BINS).reshape(wide, BINS)
                hs = np.bincount(cell, h, wide * BINS).reshape(wide, BINS)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                gain[:, len(edges[f]):] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(wide), cut]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    trees.feature[t, first + k], trees.threshold[t, first + k] = f, edges[f][cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[t, node]] > trees.threshold[t, node])
        leaf = node - inner
        trees.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        raw += trees.value[t][leaf]
    return trees


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by CRC-32 of their text; never used for fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit on at most SAMPLE labelled rows outside the held-out fifth."""
    ship(docs.sparkSession)
    use = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("__i"), F.col(label).cast("int").alias("__y"))
    # Hash order twice: the labels that are looked up are bounded (so the broadcast is), and so are the rows that they meet.
    near = use.orderBy(F.xxhash64("__i"), "__i", "__y").limit(SAMPLE)
    met = docs.select(F.col(doc_id).cast("long").alias("__i"), F.col(text).alias("__t")).join(F.broadcast(near), "__i")
    rows = met.select("__y", F.xxhash64("__i").alias("__a"), F.xxhash64("__t").alias("__b"), F.pandas_udf(text_counts, _SCHEMA)("__t").alias("s"))
    got = rows.orderBy("__a", "__b", "__y").limit(SAMPLE).select("__y", "s.*").toPandas()
    return fit(features(got), got["__y"].to_numpy(float))


_SCHEMA = ", ".join(f"{n} long" for n in COUNTS)


def quality_score(text: Column, trees: Trees) -> Column:
    """Score in [0, 1] of whole texts."""

    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(features(text_counts(texts))))

    return F.pandas_udf(walk, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``held_out``, ``score`` and ``predicted``."""
    trees = train(docs, labels, doc_id, text)
    out = docs.withColumns({"held_out": held_out(F.col(doc_id)), "score": quality_score(F.col(text), trees)})
    return out.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score of at least ``cutoff``, with their own columns alone, whatever their names."""
    return docs.where(quality_score(F.col(text), train(docs, labels, doc_id, text)) >= cutoff)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
