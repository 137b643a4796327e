"""Substring dedup: an FM-index per shard, searched backwards for whole windows of words.

``repeats`` deals segments of text to shards so that equal windows meet in one. Here a shard's
texts become one sequence of word numbers, sorted by suffixes as deep as a window, its
Burrows-Wheeler transform kept as a wavelet matrix of bit vectors with counts every 64
bits. All windows are searched at once, word by word from their last; a window whose interval has
shrunk to one row occurs nowhere else and is given up, so the statistic computed is the
match length up to the threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuscope.llm import arrays as A
from corpuscope.llm.repeats import NO_DOC, Spec, mark_repeats

WINDOW_WORDS, ANCHOR_WORDS = 13, 5


class BitVector:
    """Bits with a running count per 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % 8 + 8))
        self.words = packed.view("<u8")
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words[:-1])))).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Count and locate patterns of at most ``depth`` symbols in ``codes``."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        rank, reach = codes.astype(np.int64), 1
        while reach < depth:
            shifted = np.zeros(n, np.int64)
            shifted[:n - reach] = rank[reach:] + 1
            rank = np.unique(rank * (int(shifted.max()) + 1) + shifted, return_inverse=True)[1]
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        self.size, top = n, int(codes.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=top))))[:top]
        symbols = codes[self.order - 1]  # the symbol before each suffix
        self.levels, self.zeros = [], []
        starts = np.zeros(top, np.int64)
        names = np.arange(top)
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            vector, zeros = BitVector(bits.astype(bool)), int(len(bits) - bits.sum())
            self.levels.append((shift, vector))
            self.zeros.append(zeros)
            starts = self._down(starts, (names >> shift) & 1, vector, zeros)
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.starts = starts

    @staticmethod
    def _down(i, bit, vector, zeros):
        ones = vector.ones(i)
        return np.where(bit == 1, zeros + ones, i - ones)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol put before them."""
        for (shift, vector), zeros in zip(self.levels, self.zeros):
            bit = (symbol >> shift) & 1
            low, high = self._down(low, bit, vector, zeros), self._down(high, bit, vector, zeros)
        base = self.before[symbol] - self.starts[symbol]
        return base + low, base + high


def fm_windows(bodies: list[bytes], total: np.ndarray, first: np.ndarray, length: int):
    """(text, place, smallest doc_id, repeated) of every window of ``length`` words of the texts.

    ``total`` is how often each (distinct) text occurs, ``first`` its smallest doc_id.
    """
    buffer, begin = A.join_texts(bodies)
    start, stop = A.word_spans(buffer)
    words = np.unique(A.word_hashes(buffer, start, stop), return_inverse=True)[1] + 1
    edges = np.searchsorted(start, begin)
    counts = np.diff(edges)
    codes = np.zeros(len(words) + len(bodies), np.int64)  # a zero after each text
    text_of_word = np.repeat(np.arange(len(bodies)), counts)
    spot = np.arange(len(words)) + text_of_word
    codes[spot] = words
    index = FMIndex(codes, length)
    text_of = np.zeros(len(codes), np.int64)
    text_of[spot] = text_of_word
    room = np.maximum(counts - length + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), room)
    place = A.ranges(np.zeros(len(bodies), np.int64), room)
    at = edges[:-1][owner] + owner + place
    low, high, live = np.zeros(len(at), np.int64), np.full(len(at), index.size), np.arange(len(at))
    for step in range(length - 1, -1, -1):
        a, b = index.extend(low[live], high[live], codes[at[live] + step])
        low[live], high[live] = a, b
        live = live[b - a > 1]
    least, many = first[owner].copy(), total[owner] > 1
    if len(live):
        docs = np.append(first[text_of[index.order]], NO_DOC)
        copies = np.append(total[text_of[index.order]], 0)
        pairs = np.stack((low[live], high[live]), axis=1)
        spans, which = np.unique(pairs[:, 0], return_inverse=True)
        ends = spans.copy()
        ends[which] = pairs[:, 1]
        cuts = np.stack((spans, ends), axis=1).ravel()
        least[live] = np.minimum.reduceat(docs, cuts)[::2][which]
        many[live] = np.add.reduceat(copies, cuts)[::2][which] > 1
    return owner, place, least, many


SPEC = Spec("words", WINDOW_WORDS, ANCHOR_WORDS, True, fm_windows)


def dedup_substrings(docs: DataFrame, words: int = WINDOW_WORDS, with_text: bool = True) -> DataFrame:
    """Removes every word covered by a window of ``words`` words that also starts in a document
    with a smaller doc_id. Adds ``n_units`` (words), ``n_removed``, ``n_spans``, ``kept_sha256``
    and ``kept`` (bytes; kept words joined by one space). See ``mark_repeats`` for odd rows.
    """
    if words < 2:
        raise ValueError("a window needs two words or more")
    return mark_repeats(docs, Spec("words", words, max(1, min(ANCHOR_WORDS, words // 2)), True, fm_windows), with_text)
