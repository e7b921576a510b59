"""Vectorised hashing of words in Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes of text up to which powers are kept for each place; beyond, for each place in a word.
_PLACES = 1 << 22
#: White space: space and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int, inverse: bool = False) -> np.ndarray:
    if len(_powers[inverse]) < n:
        p = np.full(n + n // 4, pow(_BASE, -1, 1 << 64) if inverse else _BASE, U64)
        p[0] = 1
        _powers[inverse] = np.cumprod(p, dtype=U64)
    return _powers[inverse]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets; null counts as empty."""
    a = column.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, rows one after another; n + 1 bounds of rows among words; where words start.

    Words are what lies between bytes of `space`, after each byte was replaced by `fold`.
    """
    n = len(data)
    folded = fold[data]
    blank = space[folded]
    first = np.ones(n, bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(first & ~blank)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), bounds, starts
    term = folded.astype(U64) + U64(1)
    if n <= _PLACES:
        term *= _power(n)[:n]
        term[blank] = 0
        return mix(np.add.reduceat(term, starts) * _power(n, True)[starts]), bounds, starts
    place = np.zeros(n, np.int64)
    place[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(place)
    place[blank] = 0
    term *= _power(int(place.max()) + 1)[place]
    term[blank] = 0
    return mix(np.add.reduceat(term, starts)), bounds, starts


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `words` successive words; of all its words where it has fewer; empty without words."""
    h, bounds, _ = hash_words(*utf8(column))
    n = len(h)
    joined = np.zeros(n, U64)
    for k in range(words):  # order counts
        joined[: n - k] = mix(joined[: n - k] + h[k:] + U64(k + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(joined[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.zeros(1, U64)
            for k in range(b - a):
                x = mix(x + h[a + k] + U64(k + 1))
            out.append(mix(x + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
