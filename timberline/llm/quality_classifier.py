"""Operator 4: quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Their votes form
one pattern per text; patterns are counted over all texts, and expectation-
maximisation over the counted patterns (bounded in number, whatever the size
of the corpus) estimates each labeller's accuracies and the share of good
texts.  Posterior labels of the patterns then train a linear scorer over
hashed features of a bounded sample of texts, and the scorer judges all texts.

Defined results: null and empty texts get no word features and the score of
an empty text, which the labellers call bad; an empty table has an empty
result; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_statistics, words
from .batches import blocks, flat
from .durable import small_batches
from .samples import sample
from .text_statistics import RATIOS

BUCKETS = 1 << 15
#: Weights are added up as multiples of 1 / STEPS.
STEPS = 1 << 32
#: The scorer learns from about so many different texts (samples.sample()); the driver holds no more than twice as many, of bounded length.
SAMPLE_ROWS = 6000
GOOD, BAD, NOTHING = 2, 1, 0

#: Labellers: a ratio, the value from which on (or, for "below", up to which) it votes bad, and the value from which on it votes good, if it does.
LABELLERS = {
    "length": ("log_words", "below", np.log1p(2), None),
    "symbols": ("symbols", "above", 0.15, None),
    "repeated": ("repeated", "above", 0.5, None),
    "same_as_before": ("same_as_before", "above", 0.2, None),
    "dup_lines": ("dup_lines", "above", 0.5, None),
    "distinct": ("distinct", "below", 0.15, 0.6),
    "letters": ("letters", "below", 0.78, 0.95),
    "word_length": ("chars_a_word", "below", 2.0, None),
    "shouting": ("shouting", "above", 0.5, None),
}


def votes(ratio: np.ndarray) -> np.ndarray:
    """Rows x labellers: GOOD, BAD or NOTHING."""
    columns = list(RATIOS)
    out = np.zeros((len(ratio), len(LABELLERS)), np.int64)
    for k, (name, side, bad, good) in enumerate(LABELLERS.values()):
        x = ratio[:, columns.index(name)]
        is_good = x >= good if good is not None else np.zeros(len(x), bool)
        out[:, k] = np.where(x <= bad if side == "below" else x >= bad, BAD, np.where(is_good, GOOD, NOTHING))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes of a row as one number in base 3."""
    return v @ 3 ** np.arange(v.shape[1])


def unpattern(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of good for each pattern, by expectation-maximisation over class-conditional votes."""
    v = unpattern(np.asarray(patterns, np.int64))
    w = np.asarray(counts, float)
    if not len(w):
        return np.zeros(0)
    good = np.where((v == BAD).any(1), 0.1, 0.9)
    for _ in range(rounds):
        share = np.clip((w @ good) / w.sum(), 0.01, 0.99)
        logit = np.full(len(w), np.log(share / (1 - share)))
        for k in range(v.shape[1]):
            # a labeller is taken to be better than chance: its votes never speak against what they say
            n_good, n_bad = (np.array([(w * q)[v[:, k] == x].sum() for x in range(3)]) + 1 for q in (good, 1 - good))
            ratio = np.log((n_good / n_good.sum()) / (n_bad / n_bad.sum()))
            ratio[GOOD], ratio[BAD], ratio[NOTHING] = max(0.0, ratio[GOOD]), min(0.0, ratio[BAD]), 0.0
            logit += ratio[v[:, k]]
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - good).max() < 1e-6:
            return new
        good = new
    return good


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's words, of their shapes, and of repetition of the word before; and how many features precede each text."""
    starts, ends, owner = words.spans(data, offsets)
    each = words.Hasher(data)(starts, ends)
    shape = np.full(256, 0x61, np.uint8)  # letters and all beyond ASCII
    shape[: 0x41] = np.arange(0x41)
    shape[0x5B:0x61], shape[0x7B:0x80] = np.arange(0x5B, 0x61), np.arange(0x7B, 0x80)
    shape[0x30:0x3A] = 0x30
    # the shape of a word: how its first and its last byte look, and how long it is
    form = shape[data[starts]].astype(np.uint64) | shape[data[ends - 1]].astype(np.uint64) << np.uint64(8) | np.minimum((ends - starts) // 3, 5).astype(np.uint64) << np.uint64(16)
    before = np.zeros(len(each), np.uint64)
    before[1:] = each[1:] == each[:-1]
    first = owner[:-1][owner[:-1] < owner[1:]]
    before[first] = 0
    low = np.uint64(BUCKETS - 1)
    found = np.stack([each & low, words.mix(form + np.uint64(1 << 40)) & low, words.mix(before + np.uint64(1 << 41)) & low], 1).ravel()
    return found.astype(np.int64), owner * 3


@dataclass
class Scorer:
    weights: np.ndarray  # of each bucket, then of each ratio
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        found, owner = hashed(data, offsets)
        # whole numbers add up alike wherever a text stands, so equal texts have equal scores
        exact = np.rint(self.weights[:BUCKETS] * STEPS).astype(np.int64)
        x = words.per_text(exact[found], owner) / (STEPS * np.maximum(1, np.diff(owner)))
        x = x + (((ratio - self.mean) / self.scale).clip(-5, 5) * self.weights[BUCKETS:]).sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], ratio: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 5) -> Scorer:
    """Logistic regression on soft labels; bags: buckets of each text and their shares."""
    n = ratio.shape[1] if ratio.size else len(RATIOS)
    mean, scale = (ratio.mean(0), ratio.std(0) + 1e-6) if len(labels) else (np.zeros(n), np.ones(n))
    w, bias = np.zeros(BUCKETS + n), 0.0
    x = ((ratio - mean) / scale).clip(-5, 5) if len(labels) else ratio
    rng = np.random.default_rng(seed)
    for e in range(epochs):
        for k in rng.permutation(len(labels)):
            found, share = bags[k]
            p = 1 / (1 + np.exp(-np.clip(share @ w[found] + x[k] @ w[BUCKETS:] + bias, -30, 30)))
            step = rate / (1 + e) * (p - labels[k])
            w[found] -= 10 * step * share
            w[BUCKETS:] -= 0.1 * step * x[k]
            bias -= 0.1 * step
    return Scorer(w, bias, mean, scale)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Counts vote patterns over all rows, estimates the labellers, and fits a scorer on a sample."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            found = [pattern(votes(text_statistics.ratios(text_statistics.measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))) for a, b in blocks(offsets)]
            value, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["pattern", "n"])

    counted = rows.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    posterior = posteriors(counted["pattern"].to_numpy(), counted["n"].to_numpy())
    by = dict(zip(counted["pattern"].tolist(), posterior.tolist(), strict=True))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ratio = text_statistics.ratios(text_statistics.measure(part, at))
                found, owner = hashed(part, at)
                each = [np.unique(found[s:e], return_counts=True) for s, e in zip(owner.tolist(), owner[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.astype("<i4").tobytes() for x, _ in each], pa.binary()), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes() for _, n in each], pa.binary()), pa.array(list(ratio), pa.list_(pa.float64()))],
                    ["id", "buckets", "shares", "ratio"],
                )

    bags = sample(rows, SAMPLE_ROWS, "weak").mapInArrow(bag, f"id {rows.schema['id'].dataType.simpleString()}, buckets binary, shares binary, ratio array<double>")
    got = [(r.id, None, bytes(r.buckets), bytes(r.shares), list(r.ratio)) for r in bags.collect()]
    ratio = np.array([r[4] for r in got]).reshape(-1, len(RATIOS))
    labels = np.array([by[p] for p in pattern(votes(ratio)).tolist()])
    return fit([(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4")) for r in got], ratio, labels)


def scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the scorer's probability of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_all(sent.value, batch.column(1)))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score_all(scorer: Scorer, column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    out = [np.zeros(0)]
    for a, b in blocks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        out.append(scorer.score(part, at, text_statistics.ratios(text_statistics.measure(part, at))))
    return np.concatenate(out)


def classify(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, kept) of every row."""
    out = scores(docs, learn(docs, id_col, text_col), id_col, text_col)
    return out.select(id_col, "score", (F.col("score") >= least).alias("kept"))


def keep(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col))

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series(score_all(sent.value, pa.array(text, pa.string(), from_pandas=True)))

    passed: Column = score(F.col(text_col).cast("string")) >= least
    return docs.filter(passed)
