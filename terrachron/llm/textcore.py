"""Vectorised words, hashes and shingles over Arrow string columns.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, with A-Z lowered; UTF-8 never uses these
bytes inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C55
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64 for i < n, at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_text(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``max_bytes``; one longer text is one run."""
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the maximal runs of ``is_word`` that stay inside a text."""
    n = len(is_word)
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        before &= ~cut[:n]
        after &= ~cut[1:]
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of a run of texts."""
    start, end, doc = spans(~SPACE[data], off)
    return hash_spans(LOWER[data], start, end), doc


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of ``size`` values that stays inside a text."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    with np.errstate(over="ignore"):
        out = np.full(len(at), size, dtype=np.uint64)
        for j in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + j])
    return out, at


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> list[np.ndarray]:
    """The sorted distinct word shingles of each text; a shorter text is one shingle, no words give none."""
    sh, at = windows(h, doc, size)
    cut = np.searchsorted(doc[at] if len(at) else np.zeros(0, np.int64), np.arange(n_docs + 1))
    of = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for i in range(n_docs):
        if cut[i] < cut[i + 1]:
            out.append(np.unique(sh[cut[i] : cut[i + 1]]))
        elif of[i] < of[i + 1]:
            own = h[of[i] : of[i + 1]]
            out.append(windows(own, np.zeros(len(own), np.int64), len(own))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
