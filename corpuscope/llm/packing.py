"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by hash to shards of
bounded size. A shard is packed by several islands, each with its own population of
groupings: a crossover injects whole well-filled bins of one parent into the other, drops the
bins that then hold a piece twice, and best-fits the displaced pieces. Between two rounds each island hands
its elite to the next one (a ring); the fullest grouping of a shard wins. Bins left
open are pooled over all shards and packed again on a level above, until one shard is left.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import arrays as A
from corpuscope.session import cut_lineage

CAPACITY, END = 4096, 1
#: pieces a shard holds, islands of a shard, rounds between which elites migrate
SHARD_ROWS, ISLANDS, ROUNDS = 8192, 2, 2
POPULATION, GENERATIONS = 4, 6
#: bins filled less than this are packed again one level up
OPEN_BELOW = 0.98
#: words whose ids a worker keeps; beyond it the store starts anew
KEPT_WORDS = 1_000_000
#: new words that the tokenizer takes as one text, and the word put between them
JOINED_WORDS, MARK = 64, "\x01"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of whitespace-separated words, which the vocabulary never joins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` in one row, and the number of each. Words that hold the mark are encoded alone."""
        if len(self.mark) != 1 or any(MARK in w for w in words):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for e in coded for i in e], np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))
        lines = [f" {MARK} ".join(words[i:i + JOINED_WORDS]) + f" {MARK}" for i in range(0, len(words), JOINED_WORDS)]
        row = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        marked = row == self.mark[0]
        ends = np.flatnonzero(marked) - np.arange(len(words))
        return row[~marked], np.diff(ends, prepend=0)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one row, and the number of ids of each text."""
        buffer, begin = A.join_texts(texts)
        start, stop = A.word_spans(buffer)
        hashes = A.word_hashes(buffer, start, stop)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.clear()
        slot = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(slot, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            raw = buffer.tobytes()
            new = np.flatnonzero(~known)
            words = [raw[start[i]:stop[i]].decode("utf-8", "replace") for i in first[new]]
            own, size = self.look_up(words)
            at = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1]))
            self.ids = np.concatenate((self.ids, own))
            self.keys = np.insert(self.keys, slot[new], keys[new])
            self.at = np.insert(self.at, slot[new], at)
            self.size = np.insert(self.size, slot[new], size)
            slot = np.searchsorted(self.keys, keys)
        slot = slot[which]
        length = self.size[slot] if len(slot) else np.zeros(0, np.int64)
        ids = self.ids[A.ranges(self.at[slot], length)] if len(slot) else np.zeros(0, np.uint32)
        cum = np.concatenate(([0], np.cumsum(length)))
        edges = cum[np.searchsorted(start, begin)]
        return ids, np.diff(edges)


_encoders: dict[str, WordIds] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its words' ids and then ``end``; null and empty texts are the end id alone.
    Only longer documents are cut. Repeated rows give repeated pieces.
    """

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            texts, docs_ids = A.as_bytes(batch["text"]), batch["doc_id"].to_pylist()
            out = [[], [], [], [], []]
            for part in A.text_chunks(texts):
                ids, counts = encoder.encode(texts[part])
                at = 0
                for doc, n in zip(docs_ids[part], counts):
                    own = np.append(ids[at:at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for piece, low in enumerate(range(0, n + 1, capacity)):
                        row = own[low:low + capacity]
                        for column, value in zip(out, (doc, piece, low, len(row), zlib.crc32(row.tobytes()))):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
        A.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Grouping:
    """Pieces in bins: ``bins`` lists members, ``fill`` their tokens."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, items) -> Grouping:
        """Puts each piece, longest first, into the fullest bin that still takes it."""
        room = sorted((self.capacity - f, b) for b, f in enumerate(self.fill) if f < self.capacity)
        for i in items:
            size = int(self.sizes[i])
            k = bisect_left(room, (size, -1))
            if k == len(room):
                b = len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            else:
                b = room.pop(k)[1]
            self.bins[b].append(i)
            self.fill[b] += size
            if self.fill[b] < self.capacity:
                insort(room, (self.capacity - self.fill[b], b))
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then uneven fill (full bins beside empty ones)."""
        return -len(self.bins), sum((f / self.capacity) ** 2 for f in self.fill)

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.sizes), np.int32)
        for b, members in enumerate(self.bins):
            out[members] = b
        return out

    @classmethod
    def of(cls, sizes: np.ndarray, capacity: int, assignment: np.ndarray) -> Grouping:
        self = cls(sizes, capacity)
        order = np.argsort(assignment, kind="stable")
        self.bins = [p.tolist() for p in np.split(order, np.flatnonzero(np.diff(assignment[order])) + 1) if len(p)]
        self.fill = [int(sizes[p].sum()) for p in self.bins]
        return self


def crossover(a: Grouping, b: Grouping, order: np.ndarray, random: np.random.Generator) -> Grouping:
    """A child of ``b`` with some of the best-filled bins of ``a`` injected whole."""
    child = Grouping(a.sizes, a.capacity)
    full = sorted(range(len(a.bins)), key=lambda k: -a.fill[k])[: max(1, len(a.bins) // 2)]
    taken = [k for k in full if random.random() < 0.6] or full[:1]
    child.bins = [list(a.bins[k]) for k in taken]
    child.fill = [a.fill[k] for k in taken]
    held = np.zeros(len(a.sizes), bool)
    for members in child.bins:
        held[members] = True
    for members, fill in zip(b.bins, b.fill):
        if not held[members].any():
            child.bins.append(list(members))
            child.fill.append(fill)
    placed = np.zeros(len(a.sizes), bool)
    for members in child.bins:
        placed[members] = True
    return child.best_fit(order[~placed[order]].tolist())


def evolve(sizes: np.ndarray, capacity: int, seed: int, elite: np.ndarray | None = None) -> np.ndarray:
    """Bin of each piece after one island's round; stops at the bound no grouping can beat."""
    random = np.random.default_rng(seed)
    order = np.argsort(-sizes, kind="stable")
    bound = -(-int(sizes.sum()) // capacity)
    groups = [Grouping.of(sizes, capacity, elite)] if elite is not None else [Grouping(sizes, capacity).best_fit(order.tolist())]
    if len(groups[0].bins) > bound:
        while len(groups) < POPULATION:  # longest first, with some noise
            noisy = np.argsort(-sizes * random.uniform(0.7, 1.0, len(sizes)), kind="stable")
            groups.append(Grouping(sizes, capacity).best_fit(noisy.tolist()))
        for _ in range(GENERATIONS):
            groups.sort(key=Grouping.fitness, reverse=True)
            if len(groups[0].bins) <= bound:
                break
            mother, father = groups[0], groups[int(random.integers(1, len(groups)))]
            groups[-1] = crossover(mother, father, order, random)
            groups[-2] = crossover(father, mother, order, random)
    return max(groups, key=Grouping.fitness).assignment()


ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, island int"
SOLVED = f"{ITEM}, bin int, n_bins int, evenness double"


def _solve(capacity: int, round_no: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        sizes = table["length"].to_numpy()
        elite = table["bin"].to_numpy() if round_no else None
        assignment = evolve(sizes, capacity, (shard * 1009 + island * 31 + round_no) % (1 << 32), elite)
        groups = Grouping.of(sizes, capacity, assignment)
        n = table.num_rows
        return pa.table({
            **{c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "shard", "island")},
            "bin": assignment, "n_bins": pa.array(np.full(n, len(groups.bins), np.int32)),
            "evenness": pa.array(np.full(n, groups.fitness()[1]))})

    return run


def _layout(level: int, capacity: int):
    """The shard's best island: bin ids, offsets and whether a bin stays open."""

    def run(table: pa.Table) -> pa.Table:
        rank = np.lexsort((table["island"].to_numpy(), -table["evenness"].to_numpy(), table["n_bins"].to_numpy()))
        best = table["island"].to_numpy()[rank[0]]
        table = table.filter(pa.array(table["island"].to_numpy() == best))
        bins, size = table["bin"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["piece"].to_numpy(), table["doc_id"].to_pandas().to_numpy(), bins))
        bins, size, table = bins[order], size[order], table.take(pa.array(order))
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        offset = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        fill = np.bincount(bins, weights=size)[bins]
        shard = table["shard"].to_numpy()
        return pa.table({
            **{c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "sequence_id": (np.int64(level) << 56) | (shard << 16) | bins, "offset": offset,
            "open": fill < OPEN_BELOW * capacity})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every piece appears once.

    The driver only sees counts: one per level, and each level keeps about one open bin a
    shard. A level that no longer shrinks its pool ends the climb with its own grouping. An empty table gives no rows; ties are broken by
    (doc_id, piece, checksum), so equal rows are interchangeable.
    """
    pool, done, level, before = cut_lineage(pieces), [], 0, None
    while True:
        n = pool.count()
        shards = max(1, -(-n // shard_rows))
        items = pool.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(shards)))
        items = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        for r in range(ROUNDS):
            if r:  # each island goes on from its neighbour's elite
                items = items.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
            items = items.groupBy("shard", "island").applyInArrow(_solve(capacity, r), SOLVED)
        laid = items.groupBy("shard").applyInArrow(
            _layout(level, capacity), PIECES + ", sequence_id long, offset long, open boolean")
        if shards == 1 or (before is not None and n > before // 2):
            done.append(laid.drop("open"))
            break
        laid = cut_lineage(laid)
        done.append(laid.where(~F.col("open")).drop("open"))
        pool, before, level = laid.where("open").select(pieces.columns), n, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``) with their sequence and place."""
    return pack(cut_pieces(docs, tokenizer, capacity), capacity)
