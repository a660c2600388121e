"""Operator 7: language identification.

A text is the average of the embeddings of its hashed subwords (runs of 2, 3
and 4 bytes, lower-cased, all white space alike), followed by a linear
softmax.  Both are trained by stochastic gradient descent in numpy on a
bounded sample.  A temperature and a rejection threshold are fitted on a part
of the sample that the descent does not see.

Since a softmax of an average is linear in it, a fitted model is kept as one
row of logits per bucket, which is what scoring adds up.

Defined results: null texts and texts without a letter get `und` with score 0;
all other texts get a learned language; without training rows every text gets
`und`; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .batches import BLOCK_BYTES, blocks, flat
from .samples import sample
from .words import IS_BLANK

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Logits are added up as multiples of 1 / STEPS.
STEPS = 1 << 24
#: Training takes about so many different labelled rows (samples.sample()); the driver holds no more than twice as many, of bounded length.
SAMPLE_ROWS = 4000
#: A prediction is accepted if its calibrated score is at least that of all but this share of right ones.
REJECTED_SHARE = 0.01
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[IS_BLANK] = 32


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and how many precede each text (rows + 1)."""
    folded = _FOLD[data].astype(np.uint32)
    n = len(folded)
    code = folded.copy()
    out, own = [], []
    position = np.arange(n)
    end = np.repeat(offsets[1:], np.diff(offsets))
    for size in (2, 3, 4):
        code[: n - size + 1] |= folded[size - 1 :] << np.uint32(8 * (size - 1))
        at = position[: max(0, n - size + 1)]
        keep = at + size <= end[: len(at)]
        out.append((((code[: len(at)] * np.uint32(0x9E3779B1)) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(16))[keep])
        own.append(at[keep])
    found, at = np.concatenate(out), np.concatenate(own)
    order = np.argsort(at, kind="stable")
    return found[order], np.searchsorted(at[order], offsets)


def _sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's subwords, and how many there are."""
    folded = _FOLD[data].astype(np.uint32)
    n, texts = len(folded), len(offsets) - 1
    total, count = np.zeros((texts, table.shape[1]), np.int64), np.zeros(texts)
    code = folded.copy()
    for size in (2, 3, 4):
        if n < size:
            break
        code[: n - size + 1] |= folded[size - 1 :] << np.uint32(8 * (size - 1))
        rows = table[(((code[: n - size + 1] * np.uint32(0x9E3779B1)) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(16)]
        sums = np.vstack([np.zeros((1, table.shape[1]), np.int64), np.cumsum(rows, 0)])
        last = np.maximum(np.minimum(offsets[1:] - size + 1, n - size + 1), offsets[:-1].clip(max=n - size + 1))
        total += sums[last] - sums[offsets[:-1].clip(max=n - size + 1)]
        count += np.maximum(0, np.diff(offsets) - size + 1)
    return total, count


def text_logits(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Average of the table's rows over each text's subwords, in exact steps, so that equal texts have equal averages; a long text is added up in pieces."""
    table = np.rint(table.astype(np.float64) * STEPS).astype(np.int64)
    total, count = np.zeros((len(offsets) - 1, table.shape[1]), np.int64), np.zeros(len(offsets) - 1)
    if len(offsets) > 2 or len(data) <= BLOCK_BYTES:
        total, count = _sums(table, data, offsets)
    else:
        for k in range(0, len(data), BLOCK_BYTES):
            # the three bytes that the next piece begins with are needed here, but their own subwords belong there
            for piece, sign in ((data[k : k + BLOCK_BYTES + 3], 1), (data[k + BLOCK_BYTES : k + BLOCK_BYTES + 3], -1)):
                t, c = _sums(table, piece, np.array([0, len(piece)]))
                total, count = total + sign * t, count + sign * c
    return total / (STEPS * np.maximum(count, 1)[:, None])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, float32
    bias: np.ndarray
    temperature: float
    least: float


def fit(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """A model of the texts; every tenth text only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(texts))
    held, train = order[::10], np.array([k for j, k in enumerate(order) if j % 10]) if len(order) > 1 else order
    bags = []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        found, counts = np.unique(buckets(data, np.array([0, len(data)]))[0], return_counts=True)
        bags.append((found.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            found, share = bags[k]
            mean = share @ embedding[found]
            p = softmax((mean @ weights + bias)[None])[0]
            p[y[k]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= step * p
            embedding[found] -= (step * min(50.0, len(found))) * np.outer(share, back)
            done += 1
    table = embedding @ weights
    raw = np.array([bags[k][1] @ table[bags[k][0]] + bias for k in held])
    losses = {t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get))
    p = softmax(raw / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(languages, table, bias, temperature, float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang) of a sample of the different rows that may be learned from."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold(F.col(id_col)), F.lit(1)) != 0))
    return sample(rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), SAMPLE_ROWS, "language")


def fold(id_: Column) -> Column:
    """Remainder that decides whether a row is held out (0) or may be learned from; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = sorted((r.text, r.lang) for r in training_rows(docs, id_col, text_col, lang_col).collect())
    return fit([t for t, _ in rows], [lang for _, lang in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            names, scores = [], []
            for a, b in blocks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = _has_letter(part, at)
                if not m.languages:
                    letters[:] = False
                p = softmax((text_logits(m.table, part, at) + m.bias) / m.temperature)
                best = p.argmax(1)
                names += [m.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                scores.append(np.where(letters, p.max(1), 0.0))
            score = np.concatenate([np.zeros(0), *scores])
            known = np.array([x != UNKNOWN for x in names], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(known & (score >= m.least))], ["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    sums = np.concatenate([[0], np.cumsum(plain)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        points = np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        found[k] = bool((pretoken.classes()[points] <= pretoken.E).any())
    return found


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted): learns from rows outside the fold, predicts all."""
    out = predict(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
