"""Repeated windows of a corpus: anchors narrow the search, a text index decides.

A window is ``length`` consecutive symbols (words or bytes) of one document. Its anchor is
the smallest hash among the ``gram``-symbol runs inside it, so equal windows have equal
anchors, wherever they stand. Consecutive windows with one anchor form a segment.

1. *census*: each block of documents sends its distinct segments (hashes only) to the anchor's bucket.
2. *sort out*: a bucket sees all segments of an anchor. One text only: its copies settle it.
   Several: they are *open* and their texts are asked for. Too many (a hot anchor):
   the segments are taken apart into single windows, which go by fingerprints of their own.
3. *ship and search*: the texts of open segments meet in shards, where an index over them
   (FM-index for words, suffix array for bytes) finds equal windows in different segments.
4. *apply*: what was found returns to the blocks and marks the symbols of each document.

A block has one row per distinct segment however often it holds it, so no task receives
more than (number of blocks) rows for one text; nothing passes through the driver but
the corpus size. Blocks are read three times from one shuffle of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm import arrays as A

#: text bytes of a block
BLOCK_BYTES = 8 << 20
#: distinct segments of one anchor that meet in a task; beyond it windows go one by one
HOT_SEGMENTS = 20_000

SETTLED, SHIP, SPLIT, FOUND, WINDOW = 1, 2, 3, 4, 5
NO_DOC = np.iinfo(np.int64).max

CENSUS = "block int, bucket int, value binary, seg binary, n binary, doc binary, twice binary"
VERDICT = "block int, kind int, seg binary, lo binary, hi binary, first binary"
CARGO = "block int, shard int, kind int, seg binary, n binary, doc binary, size binary, body binary"


@dataclass(frozen=True)
class Spec:
    """``unit`` is words or bytes. With ``first_only`` a window counts as repeated in documents after the
    smallest doc_id that has it; otherwise in every place, if it starts anywhere else."""

    unit: str
    length: int
    gram: int
    first_only: bool
    index: Callable

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


class Segments:
    """Segments of a chunk of texts: first window, number of windows, anchor and text hash."""

    def __init__(self, texts: list[bytes], spec: Spec):
        self.spec = spec
        if spec.unit == "words":
            self.buffer, begin = A.join_texts(texts)
            self.start, self.stop = A.word_spans(self.buffer)
            symbols = A.word_hashes(self.buffer, self.start, self.stop)
            self.edges = np.searchsorted(self.start, begin)
        else:
            self.buffer = np.frombuffer(b"".join(texts), np.uint8)
            symbols = A.byte_symbols(self.buffer)
            self.edges = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.rolling = A.Rolling(symbols)
        self.at = self.many = self.doc = np.zeros(0, np.int64)
        self.value = self.hash = self.grams = np.zeros(0, np.uint64)
        room = np.diff(self.edges) - spec.length + 1
        rows = np.flatnonzero(room > 0)
        if not len(rows):
            return
        grams = self.rolling.grams(spec.gram)
        least = A.sliding(grams, spec.width)
        at = A.ranges(self.edges[rows], room[rows])
        key = least[at]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        position = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(position % spec.width == 0)
        self.at, self.many = at[first], np.diff(np.append(first, len(at)))
        self.value = key[first]
        self.doc = np.searchsorted(self.edges, self.at, side="right") - 1
        self.hash = self.rolling.spans(self.at, self.at + self.many + spec.length - 1)
        self.grams = grams

    def twice(self) -> np.ndarray:
        """Segments that hold their anchor more than once, so may repeat within themselves."""
        if not len(self.at):
            return np.zeros(0, bool)
        reach = self.many + self.spec.width - 1
        same = self.grams[A.ranges(self.at, reach)] == np.repeat(self.value, reach)
        return np.add.reduceat(same, np.concatenate(([0], np.cumsum(reach)[:-1])), dtype=np.int64) > 1

    def bodies(self, rows: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Texts of segments, words joined as they stand in the buffer."""
        low, high = self.at[rows], self.at[rows] + self.many[rows] + self.spec.length - 1
        if self.spec.unit == "words":
            low, high = self.start[low], self.stop[high - 1]
        return high - low, self.buffer[A.ranges(low, high - low)].tobytes()

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, fingerprint) of the single windows of segments."""
        at = A.ranges(self.at[rows], self.many[rows])
        return np.repeat(rows, self.many[rows]), A.mix(self.rolling.spans(at, at + self.spec.length) ^ np.uint64(0x5851F42D4C957F2D))


def _block(table: pa.Table, spec: Spec):
    """Chunks of a block's documents in id order: (rows, ids, segments)."""
    table = table.sort_by([("doc_id", "ascending")]) if spec.first_only else table
    texts = A.as_bytes(table["text"])
    ids = table["doc_id"].combine_chunks().fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)
    for part in A.text_chunks(texts):
        yield table.slice(part.start, part.stop - part.start), texts[part], ids[part]


def _segments(table: pa.Table, spec: Spec):
    for _, texts, ids in _block(table, spec):
        s = Segments(texts, spec)
        usable = ids[s.doc] != NO_DOC if spec.first_only else np.ones(len(s.doc), bool)
        yield s, ids, np.flatnonzero(usable)


def _packed(groups: np.ndarray, columns: dict[str, np.ndarray]):
    """Rows of each group value as one row of binary columns."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.zeros(0, int)
    last = np.append(first[1:], len(groups))
    columns = {k: v[order] for k, v in columns.items()}
    return groups[first], {k: [v[a:b].tobytes() for a, b in zip(first, last)] for k, v in columns.items()}


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the row each one is from."""
    raw = table[name].to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.repeat(np.arange(len(raw)), [len(r) // size for r in raw])


def _census(spec: Spec, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [(s.value[u], s.hash[u], ids[s.doc[u]], np.zeros(len(u), bool) if spec.first_only else s.twice()[u])
                 for s, ids, u in _segments(table, spec)]
        value, seg, doc, twice = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.uint64)] * 4
        seg, first, n = np.unique(seg, return_index=True, return_counts=True)  # the first row has the smallest id
        value = value[first]
        groups, packed = _packed((value >> np.uint64(20)) % np.uint64(buckets), {
            "value": value, "seg": seg, "n": n.astype(np.uint32), "doc": doc[first].astype(np.int64), "twice": twice[first].astype(np.uint8)})
        A.release()
        return pa.table({"block": pa.array(np.full(len(groups), key[0].as_py(), np.int32)),
                         "bucket": pa.array(groups.astype(np.int32)), **{k: pa.array(v, pa.binary()) for k, v in packed.items()}})

    return run


def _verdicts(block, kind, seg, lo, hi, first) -> pa.Table:
    out = []
    for k in np.unique(kind):
        m = kind == k
        groups, packed = _packed(block[m], {"seg": seg[m], "lo": lo[m].astype(np.int32), "hi": hi[m].astype(np.int32), "first": first[m]})
        out.append(pa.table({"block": pa.array(groups.astype(np.int32)), "kind": pa.array(np.full(len(groups), k, np.int32)),
                             **{c: pa.array(v, pa.binary()) for c, v in packed.items()}}))
    return pa.concat_tables(out) if out else pa.table(
        {"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("seg", "lo", "hi", "first")}})


def _sort_out(spec: Spec, hot: int):
    def run(table: pa.Table) -> pa.Table:
        value, row = _column(table, "value", np.uint64)
        block = table["block"].to_numpy()[row]
        seg, n, doc, twice = (_column(table, c, k)[0] for c, k in (("seg", np.uint64), ("n", np.uint32), ("doc", np.int64), ("twice", np.uint8)))
        order = np.lexsort((block, seg, value))
        value, seg, n, doc, twice, block = (x[order] for x in (value, seg, n, doc, twice, block))
        new_seg = np.concatenate(([True], seg[1:] != seg[:-1]))
        text = np.cumsum(new_seg) - 1
        at = np.flatnonzero(new_seg)
        total, first = np.add.reduceat(n.astype(np.int64), at), np.minimum.reduceat(doc, at)
        again = np.maximum.reduceat(twice, at)
        anchor_of_text = np.cumsum(np.concatenate(([True], value[at][1:] != value[at][:-1]))) - 1
        texts = np.bincount(anchor_of_text)[anchor_of_text]
        if spec.first_only:
            is_hot, is_open = texts > hot, texts > 1
            settled, ship = ~is_open & (total > 1), (is_open & ~is_hot)[text]
        else:
            lone = (total == 1) & ((texts > 1) | (again > 0))
            mixed = np.bincount(anchor_of_text, weights=lone)[anchor_of_text] > 0
            is_hot = mixed & (texts > hot)
            settled = (total > 1) & ~is_hot
            ship = (mixed & ~is_hot)[text] & (lone[text] | new_seg)
        rows = [(np.flatnonzero(m), k) for m, k in ((settled[text], SETTLED), (ship, SHIP), (is_hot[text], SPLIT))]
        pick = np.concatenate([r for r, _ in rows])
        kind = np.concatenate([np.full(len(r), k) for r, k in rows])
        return _verdicts(block[pick], kind, seg[pick], np.zeros(len(pick)), np.full(len(pick), 1 << 30), first[text[pick]])

    return run


def _ship(spec: Spec, shards: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        sets = {k: np.unique(_column(asked.filter(pa.array(asked["kind"].to_numpy() == k)), "seg", np.uint64)[0]) for k in (SHIP, SPLIT)}
        tables = []

        def emit(kind, value, seg, n, doc, size, body):
            cuts = np.concatenate(([0], np.cumsum(size)))
            groups = (value >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(groups, kind="stable")
            raw = np.frombuffer(body, np.uint8)
            groups, packed = _packed(groups, {"seg": seg, "n": n.astype(np.uint32), "doc": doc, "size": size.astype(np.int32)})
            split = np.split(order, np.cumsum([len(s) // 8 for s in packed["seg"]])[:-1]) if len(groups) else []
            packed["body"] = [raw[A.ranges(cuts[o], size[o])].tobytes() for o in split]
            tables.append(pa.table({
                "block": pa.array(np.full(len(groups), key[0].as_py(), np.int32)), "shard": pa.array(groups.astype(np.int32)),
                "kind": pa.array(np.full(len(groups), kind, np.int32)), **{k: pa.array(v, pa.binary()) for k, v in packed.items()}}))

        if docs.num_rows and (len(sets[SHIP]) or len(sets[SPLIT])):
            gathered: list[tuple] = []
            windows: list[tuple] = []
            for s, ids, u in _segments(docs, spec):
                mine = u[np.isin(s.hash[u], sets[SHIP])]
                if len(mine):
                    _, first = np.unique(s.hash[mine], return_index=True)
                    size, body = s.bodies(mine[np.sort(first)])
                    gathered.append((s.hash[mine], ids[s.doc[mine]], s.value[mine], mine[np.sort(first)], s.hash[mine[np.sort(first)]], size, body))
                if len(sets[SPLIT]):
                    row, mark = s.windows(u[np.isin(s.hash[u], sets[SPLIT])])
                    windows.append((mark, ids[s.doc[row]]))
            if gathered:
                seg, first, n = np.unique(np.concatenate([g[0] for g in gathered]), return_index=True, return_counts=True)
                doc, value = np.concatenate([g[1] for g in gathered])[first], np.concatenate([g[2] for g in gathered])[first]
                owner, size = np.concatenate([g[4] for g in gathered]), np.concatenate([g[5] for g in gathered])
                body = np.frombuffer(b"".join(g[6] for g in gathered), np.uint8)
                cuts = np.concatenate(([0], np.cumsum(size)))
                _, keep = np.unique(owner, return_index=True)  # a text found in two chunks is sent once
                emit(SHIP, value, seg, n, doc, size[keep], body[A.ranges(cuts[keep], size[keep])].tobytes())
            if windows:
                mark, first, n = np.unique(np.concatenate([w[0] for w in windows]), return_index=True, return_counts=True)
                emit(SPLIT, mark, mark, n, np.concatenate([w[1] for w in windows])[first], np.zeros(len(mark), np.int64), b"")
        A.release()
        return pa.concat_tables(tables) if tables else pa.table(
            {c: pa.array([], pa.int32()) for c in ("block", "shard", "kind")} | {c: pa.array([], pa.binary()) for c in ("seg", "n", "doc", "size", "body")})

    return run


def _search(spec: Spec):
    def run(table: pa.Table) -> pa.Table:
        out = []
        for kind in (SHIP, SPLIT):
            own = table.filter(pa.array(table["kind"].to_numpy() == kind))
            if not own.num_rows:
                continue
            seg, row = _column(own, "seg", np.uint64)
            block = own["block"].to_numpy()[row]
            n, doc, size = (_column(own, c, k)[0] for c, k in (("n", np.uint32), ("doc", np.int64), ("size", np.int32)))
            order = np.lexsort((doc, seg))
            at = np.flatnonzero(np.concatenate(([True], seg[order][1:] != seg[order][:-1])))
            text = np.empty(len(seg), np.int64)
            text[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(seg))))
            total, first = np.add.reduceat(n[order].astype(np.int64), at), doc[order][at]
            if kind == SPLIT:
                hit = (first[text] < doc) | (n > 1) if spec.first_only else total[text] > 1
                hit = np.flatnonzero(hit)
                out.append((block[hit], np.full(len(hit), WINDOW), seg[hit], np.zeros(len(hit)), np.ones(len(hit)), first[text[hit]]))
                continue
            body = np.frombuffer(b"".join(own["body"].to_pylist()), np.uint8)
            cuts = np.concatenate(([0], np.cumsum(size)))
            lead = order[at]
            # texts in the order of their smallest id, so that an earlier place is an earlier document
            rank = np.argsort(first, kind="stable")
            bodies = [body[cuts[i]:cuts[i + 1]].tobytes() for i in lead[rank]]
            owner, place, least, many = spec.index(bodies, total[rank], first[rank], spec.length)
            keep = np.flatnonzero((place >= 0) & ((least < NO_DOC) if spec.first_only else many))
            if not len(keep):
                continue
            owner, place, least = rank[owner[keep]], place[keep], least[keep]
            order2 = np.lexsort((place, owner))
            owner, place, least = owner[order2], place[order2], least[order2]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1] if spec.first_only else False)))
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(owner)) - 1
            # runs of each text go to every block that sent it
            run_text = owner[a]
            by_text = np.argsort(text, kind="stable")
            low, high = np.searchsorted(text[by_text], run_text), np.searchsorted(text[by_text], run_text, side="right")
            item = by_text[A.ranges(low, high - low)]
            which = np.repeat(np.arange(len(a)), high - low)
            f = least[a][which]
            useful = (f < doc[item]) | (n[item] > 1) if spec.first_only else np.ones(len(item), bool)
            item, which, f = item[useful], which[useful], f[useful]
            out.append((block[item], np.full(len(item), FOUND), seg[item], place[a][which], place[b][which] + 1, f))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
        A.release()
        return _verdicts(*columns)

    return run


def _apply(spec: Spec, fields: list[str], with_text: bool):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
        kinds = found["kind"].to_numpy()

        def columns(*wanted):
            part = found.filter(pa.array(np.isin(kinds, wanted)))
            got = [_column(part, c, k)[0] for c, k in (("seg", np.uint64), ("lo", np.int32), ("hi", np.int32), ("first", np.int64))]
            order = np.argsort(got[0], kind="stable")
            return [g[order] for g in got]

        seg, lo, hi, first = columns(SETTLED, FOUND)
        split = np.unique(columns(SPLIT)[0])
        mark, _, _, mark_first = columns(WINDOW)
        tables = []
        for rows, texts, ids in _block(docs, spec):
            s = Segments(texts, spec)
            low, high = np.searchsorted(seg, s.hash), np.searchsorted(seg, s.hash, side="right")
            i = np.repeat(np.arange(len(s.hash)), high - low)
            j = A.ranges(low, high - low)
            a, b, f = s.at[i] + lo[j], s.at[i] + np.minimum(hi[j], s.many[i]), first[j]
            doc = s.doc[i]
            if len(split):
                r, m = s.windows(np.flatnonzero(np.isin(s.hash, split)))
                place = s.at[r] + np.arange(len(r)) - np.repeat(np.flatnonzero(np.diff(r, prepend=-1)), np.unique(r, return_counts=True)[1])
                k = np.minimum(np.searchsorted(mark, m), max(len(mark) - 1, 0))
                hit = np.flatnonzero(mark[k] == m) if len(mark) else np.zeros(0, int)
                a, b = np.concatenate((a, place[hit])), np.concatenate((b, place[hit] + 1))
                f, doc = np.concatenate((f, mark_first[k[hit]])), np.concatenate((doc, s.doc[r[hit]]))
            if spec.first_only:
                ok = (f < ids[doc]) & (ids[doc] != NO_DOC)
                a, b = a[ok], b[ok]
            total = int(s.edges[-1])
            change = np.bincount(a, minlength=total + 1) - np.bincount(b + spec.length - 1, minlength=total + 1)
            gone = np.cumsum(change)[:total] > 0
            removed = np.concatenate(([0], np.cumsum(gone)))
            starts = gone & ~np.concatenate(([False], gone[:-1])) if total else gone
            if total:  # a run does not go on from one document into the next
                edge = s.edges[:-1][s.edges[:-1] < total]
                starts[edge] = gone[edge]
            spans = np.concatenate(([0], np.cumsum(starts)))
            n_removed, n_spans = np.diff(removed[s.edges]), np.diff(spans[s.edges])
            kept = []
            for d, text in enumerate(texts):
                own = gone[s.edges[d]:s.edges[d + 1]] if n_removed[d] else None
                if spec.unit == "words":
                    words = text.split()
                    kept.append(b" ".join(words if own is None else compress(words, (~own).tolist())))
                else:
                    kept.append(text if own is None else np.frombuffer(text, np.uint8)[~own].tobytes())
            out = {c: rows[c] for c in fields}
            out |= {"n_units": pa.array(np.diff(s.edges), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
            if with_text:
                out["kept"] = pa.array(kept, pa.binary())
            tables.append(pa.table(out))
        A.release()
        empty = pa.table({c: docs[c] for c in fields} | {c: pa.array([], pa.int64()) for c in ("n_units", "n_removed", "n_spans")}
                         | {"kept_sha256": pa.array([], pa.string())} | ({"kept": pa.array([], pa.binary())} if with_text else {})) if not docs.num_rows else None
        return pa.concat_tables(tables) if tables else empty

    return run


def mark_repeats(docs: DataFrame, spec: Spec, with_text: bool = True, block_bytes: int = BLOCK_BYTES,
                 hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``docs`` with ``n_units, n_removed, n_spans, kept_sha256`` and, on request, ``kept``.

    Needs ``doc_id`` and ``text``; other columns stay, those named like a result are replaced.
    Null texts are empty. With ``first_only`` a null doc_id neither gives nor loses windows,
    and repeated rows of one id keep each other's. An empty table gives an empty result.
    """
    new = ["n_units", "n_removed", "n_spans", "kept_sha256", "kept", "block"]
    docs = docs.drop(*new).withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = docs.schema.fields
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-size // block_bytes))
    spread = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    by_block = spread.groupBy("block")
    census = by_block.applyInArrow(_census(spec, blocks), CENSUS)
    verdicts = census.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_sort_out(spec, hot_segments), VERDICT)
    cargo = by_block.cogroup(verdicts.where(F.col("kind").isin(SHIP, SPLIT)).groupBy("block")).applyInArrow(_ship(spec, 2 * blocks), CARGO)
    found = cargo.repartition(blocks, "shard").groupBy("shard").applyInArrow(_search(spec), VERDICT)
    marks = verdicts.where(F.col("kind").isin(SETTLED, SPLIT)).unionByName(found)
    result = T.StructType(fields + [T.StructField(c, T.LongType()) for c in new[:3]] + [T.StructField("kept_sha256", T.StringType())]
                          + ([T.StructField("kept", T.BinaryType())] if with_text else []))
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(_apply(spec, [f.name for f in fields], with_text), result)
