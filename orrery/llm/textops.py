"""Vectorised word and gram hashing over Arrow string columns.

Texts are handled as one UTF-8 buffer.  A *word* is a maximal run of ASCII
letters, digits and non-ASCII bytes; ASCII upper case is folded, everything else
separates words.  Callers that also want non-ASCII case folding apply Spark's
``lower`` before the text gets here.  Every function works on whole texts; long
buffers are walked in slices, so that the working memory is bounded by the slice
and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice of vectorised work covers.
SLICE_BYTES = 1 << 19

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, SLICE_BYTES + 1)
_POW_INV = _powers(_P_INV, SLICE_BYTES + 1)
_FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or ("0" <= _c <= "9") or ("a" <= _c <= "z"):
        _FOLD[_b] = _b
    elif "A" <= _c <= "Z":
        _FOLD[_b] = _b + 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise; a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts whose bytes fill about one slice; a longer text is alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    kind = np.int64 if column.type == pa.large_string() else np.int32
    bounds = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def _words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word in at most one slice of bytes."""
    folded = _FOLD[raw]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = folded != 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(folded.astype(np.uint64) * _POW[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * _POW_INV[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def _long_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_words_of`` for a text of more than one slice: cut between words.

    A single word of more than a slice is hashed piecewise and stays one word.
    """
    hs, ss, es, at = [], [], [], 0
    while at < len(raw):
        stop = min(at + SLICE_BYTES, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(_FOLD[raw[at:stop]] == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_FOLD[raw[stop:]] == 0)
                stop = stop + int(rest[0]) if len(rest) else len(raw)
        if stop - at > SLICE_BYTES:
            h = np.zeros(1, np.uint64)
            for k in range(at, stop, SLICE_BYTES):
                h = mix(h + _words_of(raw[k : min(k + SLICE_BYTES, stop)])[0][:1])
            s, e = np.array([0]), np.array([stop - at])
        else:
            h, s, e = _words_of(raw[at:stop])
        hs.append(h)
        ss.append(s + at)
        es.append(e + at)
        at = stop
    return np.concatenate(hs), np.concatenate(ss), np.concatenate(es)


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices ``(i, j, first, hash, start, end)`` of a string column.

    Rows ``i`` to ``j`` own the words; row ``r`` has words ``first[r-i]`` to
    ``first[r-i+1]``; starts and ends are bytes counted from the row's own start.
    """
    raw, bounds = buffers(column)
    for i, j in slices(bounds):
        lo, hi = int(bounds[i]), int(bounds[j])
        if hi - lo > SLICE_BYTES:
            h, s, e = _long_words(raw[lo:hi])
            first = np.array([0, len(h)])
            yield i, j, first, h, s, e
            continue
        chunk = raw[lo:hi]
        inner = bounds[i : j + 1] - lo
        if j - i > 1:
            # Texts lie side by side: a separator is put between them.
            spaced = np.zeros(len(chunk) + (j - i), dtype=np.uint8)
            row = np.repeat(np.arange(j - i), np.diff(inner))
            spaced[np.arange(len(chunk)) + row] = chunk
            shift = inner + np.arange(j - i + 1)
            if len(spaced) > SLICE_BYTES:
                h, s, e = _long_words(spaced)
            else:
                h, s, e = _words_of(spaced)
            first = np.searchsorted(s, shift)
            own = np.repeat(shift[:-1], np.diff(first))
            yield i, j, first, h, s - own, e - own
        else:
            h, s, e = _words_of(chunk)
            yield i, j, np.array([0, len(h)]), h, s, e


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text and, beside, the text's number.

    A text with fewer than ``n`` words, but any, has one gram of all its words.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    g = np.zeros(len(h), dtype=np.uint64)
    left = np.repeat(first[1:], count) - np.arange(len(h))
    for k in range(n):
        part = np.zeros(len(h), dtype=np.uint64)
        if len(h) > k:
            part[: len(h) - k] = h[k:]
        part[left <= k] = 0
        g = (g + part) * np.uint64(0xD6E8FEB86659FD93)
    full = (left >= n) | ((np.repeat(count, count) < n) & (left == np.repeat(count, count)))
    return mix(g[full]), text[full]
