"""Suffix-array dedup of byte strings by longest-previous-factor arrays.

``repeats`` deals segments of text to shards so that equal windows meet in one. A shard's
texts are laid one after another, earlier documents first, and sorted by suffix (prefix
doubling, as deep as a window). For each suffix the nearest neighbours in suffix order that
start earlier in the text (previous and next smaller position) hold its longest earlier match. Equal windows are a
group, whose earliest place alone has no earlier match; it has a later one if the group has others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpuscope.llm import arrays as A
from corpuscope.llm.repeats import Spec, mark_repeats

WINDOW_BYTES, ANCHOR_BYTES = 400, 200


class SuffixOrder:
    """Suffix order to a depth of ``depth`` symbols, and the ranks met on the way."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = self.size = len(symbols)
        self.symbols = symbols
        padded = np.concatenate((symbols.astype(np.uint64), np.zeros(4, np.uint64)))
        first = sum(padded[j:n + j] << np.uint64(16 * (3 - j)) for j in range(4))
        # a rank is the first slot of the suffixes that are equal so far
        self.live = np.arange(n)
        self.ranks = [(4, self._refined(np.zeros(n, np.int64), first))]
        reach = 4
        while reach * 2 <= depth:
            self.ranks.append((reach * 2, self._joined(self.ranks[-1][1], reach)))
            reach *= 2
        #: equal for suffixes that are equal to the depth
        self.rank = self._joined(self.ranks[-1][1], depth - reach) if depth > reach else self.ranks[-1][1]
        self.order = np.argsort(self.rank, kind="stable")

    def _joined(self, rank: np.ndarray, shift: int) -> np.ndarray:
        """Ranks ``shift`` symbols deeper; only suffixes that still have an equal are sorted."""
        second = np.zeros(self.size, np.int64)
        second[:self.size - shift] = rank[shift:] + 1
        return self._refined(rank, rank[self.live] * (self.size + 2) + second[self.live])

    def _refined(self, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = rank.copy()
        if not len(key):
            return out
        order = np.argsort(key)
        key, live = key[order], self.live[order]
        group = rank[live]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        slot = group + np.arange(len(live)) - np.repeat(head, np.diff(np.append(head, len(live))))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(live)))
        out[live] = np.repeat(slot[at], size)
        self.live = live[np.repeat(size > 1, size)]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes, by equal ranks from deep to shallow."""
        out = np.zeros(len(i), np.int64)
        for depth, rank in [self.ranks[-1], *reversed(self.ranks), *[(1, self.symbols)] * 3]:
            a, b = i + out, j + out
            inside = np.flatnonzero((a < self.size) & (b < self.size))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            out[same] += depth
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, -1 for none; by pointer jumps."""
    left = np.arange(len(values)) - 1
    open_ = np.flatnonzero(left >= 0)
    while len(open_):
        open_ = open_[values[left[open_]] >= values[open_]]
        left[open_] = left[left[open_]]
        open_ = open_[left[open_] >= 0]
    return left


def longest_previous(suffixes: SuffixOrder) -> np.ndarray:
    """Length of the longest match of each position at an earlier one."""
    order = suffixes.order
    out = np.zeros(suffixes.size, np.int64)
    previous = nearest_smaller(order)
    following = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    for near, has in ((previous, previous >= 0), (following, following < len(order))):
        i = order[has]
        out[i] = np.maximum(out[i], suffixes.common(i, order[near[has]]))
    return out


def suffix_windows(bodies: list[bytes], total: np.ndarray, first: np.ndarray, length: int):
    """(text, place, smallest doc_id, repeated) of every window of ``length`` bytes of the texts."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    spot = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(bodies)), sizes)
    symbols = np.zeros(len(spot) + len(bodies), np.uint16)  # a zero after each text
    symbols[spot] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + 1
    suffixes = SuffixOrder(symbols, length)
    room = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), room)
    place = A.ranges(np.zeros(len(bodies), np.int64), room)
    at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))[owner] + place
    earlier = longest_previous(suffixes)[at] >= length
    # the earliest place of each group of equal windows names the smallest doc_id, and only it has no earlier match
    text_of = np.repeat(np.arange(len(bodies)), sizes + 1)
    order, rank = suffixes.order, suffixes.rank[suffixes.order]
    start = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
    size = np.diff(np.append(start, len(order)))
    lead, many = np.empty(suffixes.size, np.int64), np.empty(suffixes.size, bool)
    lead[order], many[order] = np.repeat(np.minimum.reduceat(order, start), size), np.repeat(size > 1, size)
    later = many[at] & (lead[at] == at)
    return owner, place, first[text_of[lead[at]]], earlier | later | (total[owner] > 1)


SPEC = Spec("bytes", WINDOW_BYTES, ANCHOR_BYTES, False, suffix_windows)


def dedup_suffixes(docs: DataFrame, keep_first: bool = True, length: int = WINDOW_BYTES, with_text: bool = True) -> DataFrame:
    """Removes bytes covered by strings of ``length`` bytes that occur more than once.

    With ``keep_first`` the occurrences in the document with the smallest doc_id stay; without
    it every occurrence goes, within one document too. Adds ``n_units`` (bytes),
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``kept`` (bytes,
    which need not be valid UTF-8 where a run starts inside a character).
    """
    if length < 8:
        raise ValueError("a window needs eight bytes or more")
    return mark_repeats(docs, Spec("bytes", length, length // 2, keep_first, suffix_windows), with_text)
