"""The operators' results by the plainest means, for small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Names that the operators use inside; as columns of a table they must not clash.
CLASHING = ["id", "row", "size", "key", "line", "hash", "node", "component", "a", "b", "_id", "_row", "_n", "starts", "part", "run", "score", "kept", "_text", "_from", "_key", "_size", "_gone", "target", "times"]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(rng: random.Random, n: int, stem: str = "w") -> str:
    return " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(n))


def rows_of(spark: SparkSession, sf: str) -> list:
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """documents with columns of clashing names; rows: (doc_id, text, source)."""
    more = ", ".join(f"`{c}` string" for c in CLASHING)
    full = [(i, t, "en" if t else None, s, len(t or ""), *["x"] * len(CLASHING)) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {more}")


def edge_rows() -> list[tuple]:
    rng = random.Random(3)
    text = sentence(rng, 300)
    long = sentence(rng, 60_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "  \n\t ", "b"), (4, "one", None), (5, text, "a"), (6, text, "a"), (6, text, "a"),
        (7, text + " end", "b"), (8, long, "a"), (9, long[:-5], None), (10, "café 世界 \U0001f600 <|endoftext|> l'été\n\n\nx", "b"),
        (11, "the same line of words here\n" * 40, "a"), (12, "\n".join(sentence(rng, 9) for _ in range(50)), None), (13, "### *** $$$ | <> && %%", "a"), (14, "a\x00b\x0bc d e", "b"),
    ]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def base_counts(text: str | None) -> dict:
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    lines = Counter(x for x in (text or "").split("\n") if words(x))
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": sum(n - 1 for n in lines.values()),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def cut(texts: list[str | None], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in raw for k in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone, spans = bytearray(len(x)), 0
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(x)))
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), len(x) - len(kept), spans, sha(kept)))
    return out


def shingles(text: str | None, n: int) -> set:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def least_reachable(n: int, linked) -> list[int]:
    """Least index reachable from each of n items by pairs of `linked`."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def components(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = least_reachable(len(rows), pairs)
    least: dict[int, int] = {}
    for k, t in enumerate(top):
        least[t] = min(least.get(t, rows[k][0]), rows[k][0])
    return [(rows[k][0], len(sets[k]), least[top[k]]) for k in range(len(rows))]


def edit_distance(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def line_groups(rows: list[tuple], fuzzy_words: int, candidate) -> dict[int, set[int]]:
    """Numbers of the lines of each doc_id that are not the first of their group; rows: (doc_id, text), ids distinct.

    candidate(x, y) tells whether the fingerprints of two normal lines call for the edit distance.
    """
    occurrences: dict[str, list[tuple]] = {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            normal = " ".join(re.sub("[0-9]+", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line)).split())
            if words(line):
                occurrences.setdefault(normal, []).append((i, k))
    lines = sorted(occurrences)
    fuzzy = [k for k, x in enumerate(lines) if len(x.split()) >= fuzzy_words]
    pairs = [(x, y) for p, x in enumerate(fuzzy) for y in fuzzy[:p] if candidate(lines[x], lines[y]) and 5 * edit_distance(lines[x], lines[y]) <= max(len(lines[x]), len(lines[y]))]
    groups: dict[int, list[tuple]] = {}
    for k, top in enumerate(least_reachable(len(lines), pairs)):
        groups.setdefault(top, []).extend(occurrences[lines[k]])
    gone: dict[int, set[int]] = {}
    for found in groups.values():
        for i, k in sorted(found)[1:]:
            gone.setdefault(i, set()).add(k)
    return gone
