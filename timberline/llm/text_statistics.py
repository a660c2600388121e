"""Counts over whole texts that quality operators share, for all texts of a block at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .batches import blocks, flat

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_distinct_words", "n_letters", "n_digits", "n_same_as_before", "n_line_ends", "n_upper"]

_TABLES = {name: np.zeros(256, np.int64) for name in ("symbols", "letters", "digits", "upper", "starts")}
_TABLES["symbols"][list(SYMBOLS)] = 1
_TABLES["letters"][[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = 1
_TABLES["upper"][range(65, 91)] = 1
_TABLES["digits"][list(b"0123456789")] = 1
_TABLES["starts"][[b for b in range(256) if b & 0xC0 != 0x80]] = 1


def _sums(table: str, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(_TABLES[table][data])])
    return at[offsets[1:]] - at[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS and MORE for each text.  Letters are ASCII letters and codepoints beyond ASCII."""
    starts, ends, owner = words.spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(owner))
    hasher = words.Hasher(data)
    each = hasher(starts, ends)
    own = words.mix(np.arange(len(offsets) - 1, dtype=np.uint64) + np.uint64(0x51ED27))
    out = {"n_words": np.diff(owner), "n_symbols": _sums("symbols", data, offsets), "n_letters": _sums("letters", data, offsets), "n_digits": _sums("digits", data, offsets), "n_upper": _sums("upper", data, offsets), "n_chars": _sums("starts", data, offsets)}
    blank = np.concatenate([[0], np.cumsum(words.IS_BLANK[data])])
    out["word_chars"] = out["n_chars"] - (blank[offsets[1:]] - blank[offsets[:-1]])

    _, first = np.unique(each ^ own[text], return_index=True)
    out["n_distinct_words"] = np.bincount(text[first], minlength=len(offsets) - 1)
    same = np.zeros(len(each), bool)
    same[1:] = (each[1:] == each[:-1]) & (text[1:] == text[:-1])
    out["n_same_as_before"] = words.per_text(same.astype(np.int64), owner)

    window, at = words.windows(each, owner, 3)
    _, back, times = np.unique(window ^ own[text[at]], return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    covered = np.zeros(len(each) + 2, bool)
    for k in range(3):
        covered[again + k] = True
    out["n_repeat_words"] = words.per_text(covered[: len(each)].astype(np.int64), owner)

    a, b, lines = words.lines(data, offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    a, b, of = a[full], b[full], of[full]
    _, first = np.unique(hasher(a, b) ^ own[of], return_index=True)
    out["n_lines"] = np.bincount(of, minlength=len(offsets) - 1)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=len(offsets) - 1)
    closed = np.isin(data[np.maximum(b - 1, 0)], list(b'.!?:"')) if len(data) else np.zeros(0, bool)
    out["n_line_ends"] = np.bincount(of[closed], minlength=len(offsets) - 1)
    return {k: v.astype(np.int64) for k, v in out.items()}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, MORE) of every row, all long; null texts count as empty."""
    names = [*COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            found = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[n] for x in found)])) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)


#: Ratios of the counts; what the models see.
RATIOS = {
    "log_words": lambda c: np.log1p(c["n_words"]),
    "chars_a_word": lambda c: c["word_chars"] / np.maximum(1, c["n_words"]),
    "symbols": lambda c: c["n_symbols"] / np.maximum(1, c["n_words"]),
    "dup_lines": lambda c: c["n_dup_lines"] / np.maximum(1, c["n_lines"]),
    "repeated": lambda c: c["n_repeat_words"] / np.maximum(1, c["n_words"]),
    "distinct": lambda c: c["n_distinct_words"] / np.maximum(1, c["n_words"]),
    "letters": lambda c: c["n_letters"] / np.maximum(1, c["word_chars"]),
    "digits": lambda c: c["n_digits"] / np.maximum(1, c["word_chars"]),
    "shouting": lambda c: c["n_upper"] / np.maximum(1, c["n_letters"]),
    "same_as_before": lambda c: c["n_same_as_before"] / np.maximum(1, c["n_words"]),
    "line_ends": lambda c: c["n_line_ends"] / np.maximum(1, c["n_lines"]),
    "words_a_line": lambda c: np.log1p(c["n_words"] / np.maximum(1, c["n_lines"])),
}


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x RATIOS as float64."""
    return np.column_stack([f({k: np.asarray(v, np.float64) for k, v in counts.items()}) for f in RATIOS.values()])
