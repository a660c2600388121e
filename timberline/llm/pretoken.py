"""Pre-tokenisation without regular expressions.

The split pattern of byte-level BPE vocabularies is compiled to a small
deterministic transducer over codepoint classes.  A block of texts becomes an
array of class numbers, cut into equal chunks.  For every chunk the whole
state map (state before -> state after) is computed in lock-step, the maps are
composed by a parallel prefix scan (function composition is associative), and
a second lock-step pass with the now known start states emits the boundaries.

Each text is split on its own: the first codepoint of a text has a class whose
transition ignores the state before it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# The codepoints with Unicode's White_Space property besides U+0020.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, ONE, R, V, EL, E, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(11)
FIRST = 16  # added to the class of a text's first codepoint
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORT = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # a boundary before this codepoint, before the previous one
CHUNK = 128


def _step(state: int, kind: int) -> tuple[int, int]:
    """State and emission after reading one codepoint of class `kind`."""
    letter = kind <= E
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (EL if state == QUOTE_L else E):
            return SHORT, 0
        after, out = _step(IN_LETTERS, kind)  # no contraction: the letter starts a token
        return after, out | BEFORE
    if state == AT_QUOTE and kind in (ONE, R, V, EL):
        return {ONE: SHORT, R: QUOTE_R, V: QUOTE_V, EL: QUOTE_L}[kind], 0
    if kind in (BLANK, SPACE):
        return (AFTER_BLANK if kind == BLANK else AFTER_SPACE), 0 if state in (AFTER_BLANK, AFTER_SPACE) else HERE
    out = {AFTER_BLANK: BEFORE, AFTER_SPACE: BEFORE | HERE}.get(state)
    if letter:
        return IN_LETTERS, (0 if state == IN_LETTERS else HERE) if out is None else out
    if kind == NUMBER:
        return IN_NUMBERS, (0 if state == IN_NUMBERS else HERE) if out is None else out
    if kind == QUOTE and state not in (IN_OTHER, AT_QUOTE, AFTER_BLANK):
        return AT_QUOTE, HERE if out is None else out
    return IN_OTHER, (0 if state in (IN_OTHER, AT_QUOTE) else HERE) if out is None else out


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, both indexed by class * 16 + state."""
    after, out = np.zeros(32 * 16, np.uint8), np.zeros(32 * 16, np.uint8)
    for kind in range(11):
        for state in range(STATES):
            after[kind * 16 + state], out[kind * 16 + state] = _step(state, kind)
            left = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
            after[(kind + FIRST) * 16 + state] = _step(START, kind)[0]
            out[(kind + FIRST) * 16 + state] = HERE | left
    return after, out


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every codepoint."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        group = unicodedata.category(chr(cp))[0]
        if group == "L":
            kinds[cp] = LETTER
        elif group == "N":
            kinds[cp] = NUMBER
    kinds[WHITE] = SPACE
    kinds[0x20] = BLANK
    for char, kind in {"s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": EL, "e": E, "'": QUOTE}.items():
        kinds[ord(char)] = kind
    return kinds


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan: row k becomes map k after ... after map 0."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    return maps


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Positions at which tokens start; kinds: classes, FIRST added at starts of texts."""
    after, out = machine()
    kinds = np.append(kinds, np.uint8(FIRST))  # stands for the end, so that open decisions before it are taken
    n = len(kinds)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, LETTER, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T).astype(np.uint16) * 16
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, chunks))
    for row in steps:
        maps = after.take(maps + row)
    state = np.empty(chunks, np.uint8)
    state[0] = START
    state[1:] = prefix_maps(np.ascontiguousarray(maps.T))[:-1, START]
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(steps):
        at = state + row
        out.take(at, out=emitted[k])
        state = after.take(at)
    flags = emitted.T.reshape(-1)[:n]
    starts = (flags & HERE) != 0
    starts[:-1] |= (flags[1:] & BEFORE) != 0
    return np.flatnonzero(starts[:-1])


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of the texts in `data`, and how many of them precede each text.

    offsets: rows + 1 byte offsets.  The second array has rows + 1 entries.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes().take(points)
    if len(points) == len(data):
        where, at = None, offsets[:-1]
    else:
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        where = np.cumsum(size) - size
        at = np.searchsorted(where, offsets[:-1])
    at = at[offsets[:-1] < offsets[1:]]
    kinds[at] += FIRST
    starts = boundaries(kinds)
    starts = starts if where is None else where[starts]
    return starts, np.searchsorted(starts, offsets)
