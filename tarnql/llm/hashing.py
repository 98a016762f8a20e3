"""Hashes of all words of a batch of texts at once, and sets of word shingles, with numpy."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Bytes of text hashed together; a longer text is taken alone.
STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _table(base: np.uint64, size: int) -> np.ndarray:
    name = str(base)
    if name not in _powers or len(_powers[name]) < size:
        gc.collect()  # a worker's earlier tasks may have left tables of theirs
        _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(size, STEP) + 1, base, np.uint64))])
    return _powers[name]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. (``np.unique`` alone takes a hash table, which is many times slower on large arrays.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def tidy(run: Callable) -> Callable:
    """The same work on batches; when a task's input ends, memory that its worker holds for nothing goes back to the system."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        _powers.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return whole


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes) for runs of rows: words offsets[i] to offsets[i + 1] are those of row first + i.

    Words are maximal runs of bytes that are not ASCII white space; ``lower`` lower-cases A-Z. Null is empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
        raw, edges = data[at[first] : at[end]], at[first : end + 1] - at[first]
        if lower:
            raw = _LOWER[raw]
        ink = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[edges] = True
        before = np.concatenate([[False], ink[:-1]]) if len(ink) else ink
        start = np.flatnonzero(ink & (~before | edge[:-1]))
        after = np.concatenate([ink[1:], [False]]) if len(ink) else ink
        stop = np.flatnonzero(ink & (~after | edge[1:])) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _table(_P, len(raw))[: len(raw)])])
        words = mix((total[stop] - total[start]) * _table(_INVERSE, len(raw))[start])
        yield first, np.searchsorted(start, edges), words
        first = end


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, of the whole sequence; of none, none."""
    n = len(words)
    if n == 0:
        return words
    size = min(width, n)
    h = np.full(n - size + 1, np.uint64(size * 0x1D8E4E27C47D124F % (1 << 64)))
    for j in range(size):
        h = mix(h ^ words[j : n - size + 1 + j])
    return distinct(h)
