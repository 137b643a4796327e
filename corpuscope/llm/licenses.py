"""License scans by patience alignment of texts with notice templates.

A notice that covers enough of a template holds at least one of its rarest words, as many of them as may
be missing and one more; the places of these words start regions around them. In a
region, words that occur once in the region and once in the template are anchors; the longest
increasing subsequence of their places fixes the alignment, and the gaps between anchors
are aligned the same way. Coverage is the aligned share of the template's words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import arrays as A

# Notices as their licenses ask for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
COVERAGE = 0.8
#: templates are broadcast; more text than this is refused
TEMPLATE_BYTES = 8 << 20


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        al, ah, bl, bh = work.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a, in_b = Counter(a[al:ah]), Counter(b[bl:bh])
        where = {w: i for i, w in enumerate(b[bl:bh], bl) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[al:ah], al) if in_a[w] == 1 and w in where]
        # longest increasing subsequence of the places in b
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for p, (_, j) in enumerate(pairs):
            k = bisect_left(tails, j)
            back[p] = ends[k - 1] if k else -1
            if k == len(tails):
                tails.append(j)
                ends.append(p)
            else:
                tails[k], ends[k] = j, p
        p, chain = ends[-1] if ends else -1, []
        while p >= 0:
            chain.append(pairs[p])
            p = back[p]
        last_a, last_b = al, bl
        for i, j in reversed(chain):
            out.append((i, j))
            work.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if chain:
            work.append((last_a, ah, last_b, bh))
    return sorted(out)


class Templates:
    """Templates with the words whose places start a region (by length: long words are rare; any choice finds all)."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float):
        self.rows = []
        for name, text in templates:
            words = _hashes([text.encode()])[0]
            if not len(words):
                continue
            need = math.ceil(coverage * len(words) - 1e-9)
            length = [len(w) for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text) if w]
            rare = np.argsort(-np.array(length), kind="stable")[:len(words) - need + 1]
            self.rows.append((name, words.tolist(), np.unique(words[rare]), np.unique(words), need))
        self.seeds = np.unique(np.concatenate([r[2] for r in self.rows])) if self.rows else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.seeds >> np.uint64(48)] = True

    def regions(self, hashes: np.ndarray, edges: np.ndarray):
        """(row, template, first word, last word) of the places to align: stretches of twice a template's length around a
        seed, where enough words are the template's."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(48)])
        at = at[np.isin(hashes[at], self.seeds)]
        doc = np.searchsorted(edges, at, side="right") - 1
        for t, (_, words, own, every, need) in enumerate(self.rows):
            hit = np.isin(hashes[at], own)
            spot, row, n = at[hit], doc[hit], len(words)
            if not len(spot):
                continue
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (np.diff(spot) > 2 * n))))
            for low, high in zip(new, np.append(new[1:], len(spot))):
                r = row[low]
                a, b = max(int(edges[r]), int(spot[low]) - 2 * n + 1), min(int(edges[r + 1]), int(spot[high - 1]) + 2 * n)
                known = np.concatenate(([0], np.cumsum(np.isin(hashes[a:b], every))))
                if (known[np.minimum(np.arange(b - a) + 2 * n, b - a)] - known[:-1]).max() >= need:
                    yield int(r), t, a, b


def _hashes(texts: list[bytes]):
    buffer, begin = A.join_texts(texts)
    start, stop = A.word_spans(buffer, A.NON_ALNUM)
    return A.word_hashes(buffer, start, stop, fold=True), np.searchsorted(start, begin)


def best_cover(words: list, template: list) -> tuple[int, int, int]:
    """(aligned words, first, last) of the best stretch of at most twice the template's length.

    A long region may hold the notice several times; it is cut at every place where the template's first
    aligned word could start.
    """
    n, best = len(template), (0, 0, 0)
    known = set(template)
    for low in range(len(words)):
        if words[low] not in known:
            continue
        pairs = patience(words[low:low + 2 * n], template)
        if pairs and len(pairs) > best[0]:
            best = (len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1)
            if best[0] == n:
                break
    return best


FOUND = "doc_id long, license_id string, coverage double, first_word long, last_word long"


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license_id, coverage, first_word, last_word`` of each notice of a document.

    A place counts for the template that covers it best (ties: the longer one, then the name);
    each template is reported once a document row, at its best and earliest place. Words are
    runs of anything but ASCII punctuation and white space, A-Z as a-z. Null and empty texts
    have no rows; repeated rows are reported again.
    """
    listed = sorted(templates)
    if sum(len(t.encode()) for _, t in listed) > TEMPLATE_BYTES:
        raise ValueError("templates exceed the size that may be broadcast")

    def scan(batches):
        known = Templates(listed, coverage)
        for batch in batches:
            texts, ids, out = A.as_bytes(batch["text"]), batch["doc_id"].to_pylist(), []
            for part in A.text_chunks(texts):
                hashes, edges = _hashes(texts[part])
                places: dict[int, list] = {}
                for row, t, low, high in known.regions(hashes, edges) if len(known.seeds) else ():
                    name, words, _, _, need = known.rows[t]
                    got, first, last = best_cover(hashes[low:high].tolist(), words)
                    if got >= need:
                        places.setdefault(row, []).append((got / len(words), len(words), name, low + first - int(edges[row]), low + last - int(edges[row])))
                for row, hits in places.items():
                    kept: dict[str, tuple] = {}
                    for hit in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[3])):
                        if hit[2] not in kept and all(hit[4] <= k[3] or hit[3] >= k[4] for k in kept.values()):
                            kept[hit[2]] = hit
                    out += [(ids[part.start + row], h[2], h[0], h[3], h[4]) for h in kept.values()]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license_id", "coverage", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)
