"""Operator 2: quality rules learned as gradient-boosted trees.

Statistics of every whole text pass fixed base rules first; texts that pass
are judged by boosted trees over ratios of the same statistics.  Trees are
grown in numpy on histograms, with monotonic constraints: more symbols, more
repeated words, more repeated lines or more words equal to the one before
never raise a score.  A fitted ensemble is a few flat arrays over all nodes,
through which all rows of a batch descend together.

Defined results: null and empty texts have no words and fail the base rules;
without labels the trees are empty and the base rules alone decide; a label
that is null is not used; equal labels of equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written
from .samples import drawn
from .text_statistics import COUNTS, MORE, RATIOS, ratios, statistics

#: Trees learn from about so many different labelled rows (samples.drawn()); the driver holds no more than twice as many.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF_ROWS, SHRINK = 40, 4, 0.2, 64, 20, 1.0
#: Direction in which a ratio may move the score.
MONOTONE = {"symbols": -1, "repeated": -1, "dup_lines": -1, "same_as_before": -1, "distinct": 1}


@dataclass
class Ensemble:
    """Nodes of all trees; a leaf points to itself on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of x."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(DEPTH):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Boosted trees for y in {0, 1} under logistic loss."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else 10.0 if y[0] else -10.0
        return Ensemble(*(np.zeros(0, np.int64),) * 2, np.zeros(0), *(np.zeros(0, np.int64),) * 2, np.zeros(0), base)
    signs = np.array([MONOTONE.get(name, 0) for name in RATIOS])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        value = float(np.clip(-g.sum() / (h.sum() + SHRINK), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, RATE * value])
        if depth == DEPTH or len(rows) < 2 * LEAF_ROWS:
            raw[rows] += RATE * value
            return me
        best = (1e-6, None)
        whole = g.sum() ** 2 / (h.sum() + SHRINK)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
            left, right = -gs / (hs + SHRINK), -(g.sum() - gs) / (h.sum() - hs + SHRINK)
            gain = gs**2 / (hs + SHRINK) + (g.sum() - gs) ** 2 / (h.sum() - hs + SHRINK) - whole
            gain[(ns < LEAF_ROWS) | (len(rows) - ns < LEAF_ROWS) | (signs[f] * (right - left) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(left[k]), float(right[k])))
        if best[1] is None:
            raw[rows] += RATE * value
            return me
        f, k, a, b = best[1]
        mid = float(np.clip((a + b) / 2, low, high))
        side = binned[rows, f] <= k
        bounds = [(low, high), (low, high)]
        if signs[f] > 0:
            bounds = [(low, mid), (mid, high)]
        elif signs[f] < 0:
            bounds = [(mid, high), (low, mid)]
        to = [grow(rows[side], depth + 1, *bounds[0]), grow(rows[~side], depth + 1, *bounds[1])]
        nodes[me][:4] = [f, float(cuts[f][k]), *to]
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Ensemble(np.array(roots), feature, threshold, left, right, value, base)


def learn(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ensemble:
    """Trees from rows of statistics() that have a label."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    known = counts.join(known, counts[id_col] == known["_id"]).select("_id", "_label", *COUNTS, *MORE)
    rows = drawn(known, SAMPLE_ROWS, "rules").toPandas()
    rows = rows.sort_values(["_id", "_label"], kind="stable")
    return fit(ratios({c: rows[c].to_numpy() for c in (*COUNTS, *MORE)}), rows["_label"].to_numpy(float))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def scored(counts: DataFrame, trees: Ensemble) -> DataFrame:
    """counts with a column score."""
    sent = counts.sparkSession.sparkContext.broadcast(trees)
    names = [*COUNTS, *MORE]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = ratios({n: c.to_numpy() for n, c in zip(names, columns, strict=True)})
        return pd.Series(np.concatenate([np.zeros(0), *(sent.value.score(x[k : k + 2000]) for k in range(0, len(x), 2000))]))

    return counts.withColumn("score", score(*names))


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, COUNTS, base_failed, score, kept) of every row; kept: passes the base rules and scores `least` at least."""
    counts = written(statistics(docs, id_col, text_col))
    out = scored(counts, learn(counts, labels, id_col, label_col)).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.select(id_col, *COUNTS, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= least)).alias("kept"))
