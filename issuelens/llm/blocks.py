"""Arrays over the bytes of several texts at once, for code inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Hands freed memory back to the system: Python workers live on after a task and would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]))
        if n < 1 << 23:
            _powers[key] = have
    return have[:n]


def runs(sizes: Sequence[int] | np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows whose sizes sum to limit at most; a larger row comes alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class Words:
    """Words of some texts: start, end and hash of each, and of which text it is; A-Z count as a-z in hashes."""

    def __init__(self, texts: Sequence[bytes]):
        self.n = len(texts)
        self.raw = np.frombuffer(b" ".join(texts), np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])[: self.n]
        ink = ~BLANK[self.raw]
        edge = np.diff(ink.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=self.n).astype(np.int64)
        #: Of each text, the index of its first word.
        self.first = np.concatenate([[0], np.cumsum(self.count)])[: self.n]

    def hashes(self) -> np.ndarray:
        m = len(self.raw)
        with np.errstate(over="ignore"):
            total = np.empty(m + 1, np.uint64)
            total[0] = 0
            np.cumsum((LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * _power(_BASE, m), out=total[1:])
            return mix64((total[self.end] - total[self.start]) * _power(_INVERSE, m + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def windows(words: Words, k: int, hashes: np.ndarray | None = None, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words inside a text, and of which text it is. whole_if_short: a text of 1 to k-1 words has one window, all of it."""
    h = words.hashes() if hashes is None else hashes
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= k:
            out = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                out = mix64(out + h[j : n - k + 1 + j] + np.uint64(j + 1))
            inside = words.text[: n - k + 1] == words.text[k - 1 :]
            out, text = out[inside], words.text[: n - k + 1][inside]
        else:
            out, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if whole_if_short:
            short = np.flatnonzero((words.count > 0) & (words.count < k))
            if len(short):
                extra = np.zeros(len(short), np.uint64)
                for j in range(k - 1):
                    has = words.count[short] > j
                    at = np.minimum(words.first[short] + j, n - 1)
                    extra = np.where(has, mix64(extra + h[at] + np.uint64(101 * (j + 1))), extra)
                out, text = np.concatenate([out, extra]), np.concatenate([text, short])
                order = np.argsort(text, kind="stable")
                out, text = out[order], text[order]
    return out, text
