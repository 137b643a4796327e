"""Benchmark decontamination: SimHash windows, Hamming blocks, weighted-shingle verification.

Every window of a document that is as long as an item is compared with it; a document shorter than the
item is one window as a whole. A window can only reach the
similarity if enough of its shingles are item shingles, which a running count tells for all
windows at once. Those windows get a 64-bit SimHash of their shingles; its four 16-bit blocks look up the items
that differ in at most ``RADIUS // 4`` bits of a block, which finds every item within
``RADIUS`` bits. Candidates are verified by the exact similarity, the shingle counts' sum of
minima over the sum of maxima.

Items are read in blocks of bounded size; each block is one pass over the documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import arrays as A
from corpuscope.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
#: at similarity 0.8 the expected distance is 9.4 bits; 20 is 3.6 standard deviations above
RADIUS = 20
#: items and text bytes of one broadcast block
BLOCK_ITEMS, BLOCK_BYTES = 512, 4 << 20

_NEAR = np.array([x for x in range(1 << 16) if x.bit_count() <= RADIUS // 4], np.uint32)


def simhash(marks: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the shingles of each range; a shingle weighs as often as it occurs."""
    out = np.zeros(len(start), np.uint64)
    for bit in range(64):
        ones = np.concatenate(([0], np.cumsum((marks >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        out |= (2 * (ones[start + size] - ones[start]) > size).astype(np.uint64) << np.uint64(bit)
    return out


class Items:
    """A block of items: shingles by item, the set of all of them, and the Hamming blocks of each length."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        buffer, begin = A.join_texts(texts)
        start, stop = A.word_spans(buffer)
        hashes = A.word_hashes(buffer, start, stop, fold=True)
        edges = np.searchsorted(start, begin)
        self.ids, self.words = np.array(ids, np.int64), np.diff(edges)
        self.groups = {}
        self.prints = np.zeros(len(ids), np.uint64)
        for n in np.unique(self.words[self.words > 0]):
            k = min(SHINGLE, int(n))
            own = np.flatnonzero(self.words == n)
            grams = A.word_grams(hashes, k)
            marks = np.stack([grams[edges[i]:edges[i] + n - k + 1] for i in own])
            prints = simhash(marks.ravel(), np.arange(len(own)) * marks.shape[1], np.full(len(own), marks.shape[1]))
            self.prints[own] = prints
            self.groups[int(n)] = (k, own, np.sort(marks, axis=1), np.unique(marks))
        self.tables = self._tables(self.prints)

    @staticmethod
    def _tables(prints: np.ndarray):
        """For each 16-bit block: the items, of any length, near each block value, as (offsets, items)."""
        out = []
        for j in range(4):
            part = ((prints >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.uint32)
            value = (part[:, None] ^ _NEAR[None]).ravel()
            item = np.repeat(np.arange(len(prints), dtype=np.int32), len(_NEAR))
            order = np.argsort(value, kind="stable")
            out.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)).astype(np.int32), item[order]))
        return out


def leaks_in(items: Items, texts: list[bytes]):
    """(row, item, similarity, first word, words) of the best window of each leak."""
    buffer, begin = A.join_texts(texts)
    start, stop = A.word_spans(buffer)
    hashes = A.word_hashes(buffer, start, stop, fold=True)
    edges = np.searchsorted(start, begin)
    words = np.diff(edges)
    found: dict[tuple[int, int], tuple] = {}
    known: dict[int, tuple] = {}
    for n, (k, own, marks, union) in items.groups.items():
        m = n - k + 1
        if k not in known:
            grams = A.word_grams(hashes, k)
            every = np.unique(np.concatenate([g[3] for g in items.groups.values() if g[0] == k]))
            bits = np.zeros(1 << 20, bool)
            bits[every >> np.uint64(44)] = True
            maybe = np.flatnonzero(bits[grams >> np.uint64(44)])
            slot = np.minimum(np.searchsorted(every, grams[maybe]), len(every) - 1)
            known[k] = (grams, maybe[every[slot] == grams[maybe]])
        grams, hits = known[k]
        slot = np.minimum(np.searchsorted(union, grams[hits]), len(union) - 1)
        hits = hits[union[slot] == grams[hits]]
        if not len(hits):
            continue
        # a window that holds enough hits begins at most m - 1 before the first of them
        reach = np.unique((hits[:, None] - np.arange(m)[None]).ravel())
        reach = reach[reach >= 0]
        doc = np.searchsorted(edges, reach, side="right") - 1
        reach = reach[reach + n <= edges[doc + 1]]
        short = np.flatnonzero((words < n) & (words >= k))
        held = np.concatenate((np.full(len(reach), m), words[short] - k + 1))
        reach = np.concatenate((reach, edges[short]))
        need = np.ceil(SIMILARITY * (m + held) / (1 + SIMILARITY) - 1e-9)
        inside = np.searchsorted(hits, reach + held) - np.searchsorted(hits, reach)
        reach, held = reach[inside >= need], held[inside >= need]
        if not len(reach):
            continue
        flat, at = grams[A.ranges(reach, held)], np.cumsum(held) - held
        window = simhash(flat, at, held)
        pairs, place = [], np.full(len(items.words), -1)
        place[own] = np.arange(len(own))
        for j, (offsets, near) in enumerate(items.tables):
            part = ((window >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)
            size = (offsets[part + 1] - offsets[part]).astype(np.int64)
            w, i = np.repeat(np.arange(len(reach)), size), place[near[A.ranges(offsets[part].astype(np.int64), size)]]
            pairs.append((w * len(own) + i)[i >= 0])  # items of this length
        key = np.unique(np.concatenate(pairs))
        w, i = key // len(own), key % len(own)
        close = np.bitwise_count(window[w] ^ items.prints[own[i]]) <= RADIUS
        for w, i in zip(w[close], i[close]):
            a, b = np.unique(flat[at[w]:at[w] + held[w]], return_counts=True), np.unique(marks[i], return_counts=True)
            _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
            common = int(np.minimum(a[1][x], b[1][y]).sum())
            score = common / (m + held[w] - common)
            if score >= SIMILARITY:
                row = int(np.searchsorted(edges, reach[w], side="right") - 1)
                best = (score, -int(reach[w] - edges[row]), int(held[w]) + k - 1)
                pair = (row, int(own[i]))
                if pair not in found or best > found[pair]:
                    found[pair] = best
    return [(row, int(items.ids[i]), score, -low, n) for (row, i), (score, low, n) in sorted(found.items())]


LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _item_blocks(spark: SparkSession, benchmark: DataFrame):
    """Broadcast blocks of the items that have a text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text IS NOT NULL")
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-sizes.n // (BLOCK_ITEMS // 2)), -(-(sizes.bytes or 0) // (BLOCK_BYTES // 2)))
    items = cut_lineage(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
    for part in range(parts):
        block = items.where(F.col("part") == part).orderBy("item_id", "text").toArrow()
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, block["item_id"].to_pylist(), A.as_bytes(block["text"])))


def _known(shared) -> Items:
    """The block's items, built once a worker, which keeps one block."""
    name, ids, texts = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Items(list(range(len(ids))), texts)
    return _built[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document id and item that has a window of at least ``SIMILARITY``.

    Words are runs of anything but ASCII white space, A-Z as a-z. An item with fewer than five words has its
    whole sequence as one shingle; items and documents without words never match. A document shorter than an item is
    compared as a whole. Null item ids are left out; a null doc_id is reported as null. Equal ids are reported once, with their
    best window (ties: the earliest).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _item_blocks(docs.sparkSession, benchmark.where("item_id IS NOT NULL")):
        def scan(batches, shared=shared):
            known, ids = _known(shared), shared.value[1]
            for batch in batches:
                own, doc_ids = A.as_bytes(batch["text"]), batch["doc_id"].to_pylist()
                rows = [(doc_ids[part.start + r], ids[i], *rest) for part in A.text_chunks(own) for r, i, *rest in leaks_in(known, own[part])]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])
            A.release()

        found = rows.mapInArrow(scan, LEAKS)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("early"), "n_words")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.early")).alias("first_word"), "best.n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no item, whatever the ids of documents and items are."""
    for shared in _item_blocks(docs.sparkSession, benchmark):
        def clean(batches, shared=shared):
            known = _known(shared)
            for batch in batches:
                own = A.as_bytes(batch["text"])
                keep = np.ones(len(own), bool)
                for part in A.text_chunks(own):
                    keep[[part.start + r for r, *_ in leaks_in(known, own[part])]] = False
                yield batch.filter(pa.array(keep))
            A.release()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


_built: dict[str, Items] = {}
