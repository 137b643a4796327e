"""Vectorised text helpers that run inside tasks: word spans, hashes, windows.

Texts are handled as UTF-8 bytes in chunks of a few megabytes, so a task's
memory does not grow with its partition; one very long text is its own chunk.
All hashes are functions of the content alone (no process seed), so a retried
task gives the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: bytes that separate words: space and \x09-\x0D
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: every ASCII byte that is neither letter nor digit separates
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 8 * CHUNK_BYTES:  # one huge text: do not keep its table
        _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Prefix sums that give the hash of any run of symbols in O(1)."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of ``k`` symbols."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


def byte_symbols(buffer: np.ndarray) -> np.ndarray:
    return _TABLE[buffer]


def word_spans(buffer: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of a buffer."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~separators[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``fold`` lower-cases A-Z first."""
    out = np.empty(len(start), np.uint64)
    table = _TABLE[_FOLD] if fold else _TABLE
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + CHUNK_BYTES)))
        low = start[first]
        roll = Rolling(table[buffer[low:stop[last - 1]]])
        out[first:last] = roll.spans(start[first:last] - low, stop[first:last] - low)
        first = last
    return out


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= _BASE
        total += hashes[j:j + n]
    return mix(total)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line break after each text, and where each text starts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), begin


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as bytes, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Row ranges whose sizes add up to about ``limit``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    return chunks(np.fromiter(map(len, texts), np.int64, len(texts)), limit)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return np.arange(total) + shift


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
