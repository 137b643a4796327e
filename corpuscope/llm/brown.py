"""Language-model scoring with Brown classes from exchange clustering.

Words that occur more than once in the training documents are clustered: each round moves words to the
class that raises the class-bigram likelihood most, given the counts of all training documents.
Words seen once stand for those never seen, which have no neighbours to learn from: both belong to a class by their
last letters. The probability of a token is its class after the previous token's class, times the word within its class.

Counts are exact for every word: blocks of documents send their distinct words to a bucket
each and get the corpus counts back, so no task or driver holds the vocabulary. A bucket keeps the
words that hash to it, their classes and the blocks that use them. A round sends the classes to the blocks, and the blocks'
counts of neighbouring classes back; only the class bigrams are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import arrays as A
from corpuscope.llm.toxicity import fold_of
from corpuscope.session import cut_lineage, dealt, free_unused, stored

#: occurrences from which on a word is clustered, whatever the size of the corpus
FLOOR = 2
CLASSES, TAILS, ROUNDS = 64, 64, 4
#: weight of the class frequencies in the transitions
BACKOFF = 5.0
BLOCK_BYTES = 8 << 20

END = CLASSES + TAILS
WIDTH = END + 1

CENSUS = "block int, bucket int, word binary, n binary, tail binary"
COUNTED = "block int, word binary, c binary, v long, types binary, tokens binary, class binary, users binary, uses binary, places binary"
ENCODED = ("block int, doc_id binary, missing binary, held binary, size binary, known binary, base binary, rare binary, symbols binary, "
           "head binary, count binary, v long, types binary, tokens binary, class binary, users binary, uses binary, places binary")
#: a bucket: its words, their corpus counts and classes; blocks that use some of them, how many each, and which
STATE = "bucket int, words binary, counts binary, class binary, users binary, uses binary, places binary"
DELIVERED = "block int, bucket int, class binary"
#: bucket -1 holds a block's class bigrams in ``n``
CONTEXTS = "bucket int, words binary, sizes binary, keys binary, n binary"
#: words and entries of one step of an exchange pass, and the share of all tokens that may move in it
STEP_WORDS, STEP_ENTRIES, STEP_SHARE = 16, 1 << 14, 1 << 10


def _words(table: pa.Table):
    """Chunks of a block: (row slice, hashes, words per row, tail class per word)."""
    texts = A.as_bytes(table["text"])
    for part in A.text_chunks(texts):
        buffer, begin = A.join_texts(texts[part])
        start, stop = A.word_spans(buffer)
        edges = np.searchsorted(start, begin)
        last = buffer[np.maximum(stop - 1, 0)].astype(np.uint64) | np.uint64(32)
        second = buffer[np.maximum(stop - 2, start)].astype(np.uint64) | np.uint64(32)
        tail = (A.mix(last * np.uint64(256) + second) % np.uint64(TAILS)).astype(np.uint8)
        yield part, A.word_hashes(buffer, start, stop, fold=True), edges, tail


def _census(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        A.release()  # of the group before
        held = table["held"].to_numpy(zero_copy_only=False).astype(bool)
        parts = []
        for part, h, edges, tail in _words(table):
            train = np.repeat(~held[part], np.diff(edges))
            u, first, which = np.unique(h, return_index=True, return_inverse=True)
            parts.append((u, np.bincount(which, weights=train, minlength=len(u)), tail[first]))
        word, n, tail = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint8))
        word, first, which = np.unique(word, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(word)).astype(np.uint32)
        group = word % np.uint64(buckets)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(buckets + 1, dtype=np.uint64))
        own = [(b, order[cuts[b]:cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        tail = tail[first]
        return pa.table({"block": pa.array([key[0].as_py()] * len(own), pa.int32()), "bucket": pa.array([b for b, _ in own], pa.int32()),
                         **{c: pa.array([x[o].tobytes() for _, o in own], pa.binary()) for c, x in (("word", word), ("n", n), ("tail", tail))}})

    return run


def _count(floor: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw = table["word"].to_pylist()
        word, n, tail = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("word", np.uint64), ("n", np.uint32), ("tail", np.uint8)))
        u, first, which = np.unique(word, return_index=True, return_inverse=True)
        c = np.bincount(which, weights=n, minlength=len(u)).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum([len(r) // 8 for r in raw])))
        rare = (c > 0) & (c < floor)
        types = np.bincount(tail[first][rare], minlength=TAILS).astype(np.int64)
        tokens = np.bincount(tail[first][rare], weights=c[rare], minlength=TAILS).astype(np.int64)
        back = c[which]
        is_head = c >= floor
        spread = A.mix(u)  # every fourth word starts anywhere, so that words that end alike can part
        start = np.where(spread >> np.uint64(62) == 0, spread % np.uint64(CLASSES), tail[first] % CLASSES).astype(np.uint8)
        own = is_head[which]
        places = (np.cumsum(is_head) - 1)[which][own].astype(np.uint32)  # of the blocks' words, one block after another
        uses = np.diff(np.concatenate(([0], np.cumsum(own)))[cuts])
        users = table["block"].to_numpy()
        # block -1-bucket carries the bucket's share of the corpus totals and its words to be clustered
        last = lambda x: pa.array([*([b""] * len(raw)), x.tobytes()], pa.binary())
        return pa.table({
            "block": pa.concat_arrays([table["block"].combine_chunks(), pa.array([-1 - key[0].as_py()], pa.int32())]),
            "word": pa.array([*raw, u[is_head].tobytes()], pa.binary()),
            "c": pa.array([*(back[a:b].tobytes() for a, b in zip(cuts, cuts[1:])), c[is_head].tobytes()], pa.binary()),
            "v": pa.array([*([0] * len(raw)), int((c > 0).sum())], pa.int64()),
            "types": last(types), "tokens": last(tokens), "class": last(start[is_head]),
            "users": last(users[uses > 0].astype(np.int32)), "uses": last(uses[uses > 0].astype(np.int64)), "places": last(places)})

    return run


def _encode(floor: int):
    """Per block: tokens as places in the block's list of head words, or a tail class behind it."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, counts: pa.Table) -> pa.Table:
        A.release()  # of the group before
        names = [f.split()[0] for f in ENCODED.split(", ")]
        out: dict = {c: b"" for c in names} | {"block": key[0].as_py(), "v": 0}
        if not docs.num_rows:
            out |= {c: counts[c][0].as_py() for c in ("v", "types", "tokens", "class", "users", "uses", "places")}
            out |= {"head": counts["word"][0].as_py(), "count": counts["c"][0].as_py()}
        else:
            word, c = (np.frombuffer(b"".join(counts[n].to_pylist()), k) for n, k in (("word", np.uint64), ("c", np.int64)))
            order = np.argsort(word)
            word, c = word[order], c[order]
            is_head = c >= floor
            spot = np.cumsum(is_head) - 1
            heads = int(is_head.sum())
            narrow = np.uint16 if heads + TAILS < 1 << 16 else np.uint32
            size, known, base, rare, symbols = [], [], [], [], []
            for _, h, edges, tail in _words(docs):
                at = np.searchsorted(word, h)
                n = c[at] if len(h) else np.zeros(0, np.int64)
                top = is_head[at] if len(h) else np.zeros(0, bool)
                code = np.where(top, spot[at] if len(h) else 0, heads + tail.astype(np.int64))
                logs = np.log10(n + 1)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])  # noqa: B023, E731
                size.append(np.diff(edges))
                known.append(sums(n > 0))
                base.append(sums(logs))
                rare.append(sums(np.where(top, 0, logs)))
                symbols.append(np.insert(code, edges[1:], heads + TAILS).astype(narrow))
            ids = docs["doc_id"].combine_chunks()
            cat = lambda x, k: np.concatenate(x).astype(k).tobytes()
            out |= {"doc_id": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    "missing": np.array(ids.is_null()).astype(np.uint8).tobytes(),
                    "held": docs["held"].to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                    "size": cat(size, np.int64), "known": cat(known, np.int64), "base": cat(base, float), "rare": cat(rare, float),
                    "symbols": cat(symbols, narrow), "head": word[is_head].tobytes(), "count": c[is_head].tobytes()}
        kinds = {"block": pa.int32(), "v": pa.int64()}
        return pa.table({c: pa.array([out[c]], kinds.get(c, pa.binary())) for c in names})

    return run


def _block(table: pa.Table) -> dict:
    """Decoded columns of an encoded block."""
    kinds = {"size": np.int64, "known": np.int64, "base": float, "rare": float, "doc_id": np.int64, "missing": np.uint8,
             "held": np.uint8, "head": np.uint64, "count": np.int64}
    row = {c: np.frombuffer(table[c][0].as_py(), k) for c, k in kinds.items() if c in table.column_names}
    row["symbols"] = np.frombuffer(table["symbols"][0].as_py(), np.uint16 if len(row["head"]) + TAILS < 1 << 16 else np.uint32)
    return row


def _by_bucket(head: np.ndarray, buckets: int) -> np.ndarray:
    """Places of a block's words in the order in which their buckets send classes."""
    return np.argsort(head % np.uint64(buckets), kind="stable")


def _classes_of(order: np.ndarray, sent: pa.Table) -> np.ndarray:
    """Class of each symbol of a block."""
    by = np.argsort(sent["bucket"].to_numpy())
    parts = sent["class"].to_pylist()
    own = np.zeros(len(order), np.int64)
    own[order] = np.frombuffer(b"".join(parts[i] for i in by), np.uint8)
    return np.concatenate((own, CLASSES + np.arange(TAILS), [END])).astype(np.int64)


def _deliver(batches):
    """The classes of a bucket's words for each block that uses them."""
    for batch in batches:
        for i in range(batch.num_rows):
            classes, users, uses, places = (np.frombuffer(batch[c][i].as_py(), k) for c, k in (("class", np.uint8), ("users", np.int32), ("uses", np.int64), ("places", np.uint32)))
            cuts = np.concatenate(([0], np.cumsum(uses)))
            sent = classes[places]
            yield pa.RecordBatch.from_arrays(
                [pa.array(users, pa.int32()), pa.array(np.full(len(users), batch["bucket"][i].as_py()), pa.int32()),
                 pa.array([sent[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["block", "bucket", "class"])


def in_turn(words: np.ndarray, parity: int) -> np.ndarray:
    """Words that may move in a round: half of them, by another bit than those that choose the bucket."""
    return (A.mix(words) >> np.uint64(63)) == np.uint64(parity)


def _contexts(buckets: int, parity: int | None):
    """Per word in turn: counts of the classes before and after it in a block's training documents; and the block's class bigrams."""

    def run(key: tuple[pa.Scalar, ...], block: pa.Table, sent: pa.Table) -> pa.Table:
        A.release()  # of the group before
        row = _block(block)
        order = _by_bucket(row["head"], buckets)
        of = _classes_of(order, sent)
        symbol = row["symbols"].astype(np.int64)
        cls = of[symbol]
        train = np.repeat(row["held"] == 0, row["size"] + 1)
        before = np.concatenate(([END], cls[:-1]))[train]  # the end of a text stands before the next
        own, cls = symbol[train], cls[train]
        after = np.concatenate((cls[1:], [END]))
        bigrams = np.bincount(before * WIDTH + cls, minlength=WIDTH * WIDTH).astype(np.int64)
        columns: list = [(-1, b"", b"", b"", bigrams.tobytes())]
        if parity is not None:
            heads = len(row["head"])
            rank = np.empty(heads + TAILS + 1, np.int64)
            rank[order], rank[heads:] = np.arange(heads), -1
            rank[:heads][~in_turn(row["head"], parity)] = -1
            rank = rank[own]
            mine = rank >= 0
            rank = rank[mine] * (2 * WIDTH)
            entry, n = np.unique(np.concatenate((rank + before[mine], rank + WIDTH + after[mine])), return_counts=True)
            word, size = np.unique(entry // (2 * WIDTH), return_counts=True)
            words = row["head"][order][word]
            group = (words % np.uint64(buckets)).astype(np.int64)
            cuts = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]))
            ends = np.concatenate(([0], np.cumsum(size)))
            entry, n, size = (entry % (2 * WIDTH)).astype(np.uint16), n.astype(np.uint32), size.astype(np.uint16)
            columns += [(int(group[a]), words[a:b].tobytes(), size[a:b].tobytes(), entry[ends[a]:ends[b]].tobytes(), n[ends[a]:ends[b]].tobytes())
                        for a, b in zip(cuts, cuts[1:])]
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*columns), kinds)], names=["bucket", "words", "sizes", "keys", "n"])

    return run


def exchange(word: np.ndarray, key: np.ndarray, n: np.ndarray, classes: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """One exchange pass: each word, the most frequent first, goes to the class that makes the
    class-bigram likelihood largest, and the bigram table follows. Rare words are taken many at a time.

    Entries ``(word, key, n)`` are sorted by word: ``n`` times the class ``key`` stands before the word, or from ``WIDTH`` on
    the class ``key - WIDTH`` after it.
    """
    def h(x):
        return x * np.log(np.maximum(x, 1.0))

    table, out = bigrams.astype(float), classes.copy()
    begin = np.searchsorted(word, np.arange(len(classes) + 1))
    sizes = np.diff(begin)
    total = np.bincount(word, weights=n * (key < WIDTH), minlength=len(classes))
    todo = np.argsort(-total, kind="stable")
    todo = todo[sizes[todo] > 0]
    share = max(1.0, table.sum() / STEP_SHARE)
    for step in A.chunks(np.maximum(sizes[todo] / STEP_ENTRIES, np.maximum(total[todo] / share, 1 / STEP_WORDS)), 1.0):
        ids = todo[step]
        at = A.ranges(begin[ids], sizes[ids])
        w = np.repeat(np.arange(len(ids)), sizes[ids])
        side, c, x = (key[at] >= WIDTH).astype(np.int64), key[at].astype(np.int64) % WIDTH, n[at].astype(float)
        a, each = out[ids].astype(np.int64), np.arange(len(ids))
        dense = np.zeros((2, len(ids), WIDTH))
        dense[side, w, c] = x
        # the corpus without the word: the neighbour's bigrams with each class
        bare = np.stack((table[:, :CLASSES], table.T[:, :CLASSES]))[side, c]
        bare[np.arange(len(w)), a[w]] -= x
        same = np.flatnonzero(c == a[w])
        bare[same] -= dense[1 - side[same], w[same], :CLASSES]
        np.maximum(bare, 0, out=bare)
        gain = np.add.reduceat(h(bare + x[:, None]) - h(bare), np.cumsum(sizes[ids]) - sizes[ids], axis=0)
        for margin in (table.sum(axis=1)[:CLASSES], table.sum(axis=0)[:CLASSES]):
            rest = np.repeat(margin[None], len(ids), axis=0)
            rest[each, a] -= total[ids]
            gain -= h(rest + total[ids][:, None]) - h(rest)
        best = gain.argmax(axis=1)
        moves = np.flatnonzero(gain[each, best] > gain[each, a] + 1e-9)
        for sign, where in ((-1, a[moves]), (1, best[moves])):
            np.add.at(table.T, where, sign * dense[0, moves])
            np.add.at(table, where, sign * dense[1, moves])
            np.maximum(table, 0, out=table)
        out[ids[moves]] = best[moves]
    return out


def best_moves(places: np.ndarray, counts: np.ndarray, classes: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """An exchange pass over the words at ``places``, with their full tables of counts."""
    word, key = np.nonzero(counts.reshape(len(counts), -1))
    return exchange(word, key, counts.reshape(len(counts), -1)[word, key], classes[places], bigrams)


def _moves(bigrams):
    def run(key: tuple[pa.Scalar, ...], state: pa.Table, counts: pa.Table) -> pa.Table:
        A.release()  # of the group before
        if not counts.num_rows:
            return state
        words, classes = np.frombuffer(state["words"][0].as_py(), np.uint64), np.frombuffer(state["class"][0].as_py(), np.uint8)
        own, sizes, keys, n = (np.frombuffer(b"".join(counts[c].to_pylist()), k) for c, k in (("words", np.uint64), ("sizes", np.uint16), ("keys", np.uint16), ("n", np.uint32)))
        entry, which = np.unique(np.repeat(np.searchsorted(words, own), sizes) * (2 * WIDTH) + keys, return_inverse=True)
        moved = exchange(entry // (2 * WIDTH), entry % (2 * WIDTH), np.bincount(which, weights=n), classes, bigrams.value)
        return state.set_column(state.column_names.index("class"), "class", pa.array([moved.astype(np.uint8).tobytes()], pa.binary()))

    return run


def _added(column: str, kind):
    """Sum of the arrays in a column, a row a partition."""

    def run(batches):
        total = None
        for batch in batches:
            for x in batch[column].to_pylist():
                total = np.frombuffer(x, kind) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    return run


def score_texts(docs: DataFrame, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, floor: int = FLOOR) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Learns from the rows whose crc32(doc_id as text) mod 7 is not 2. Null and empty texts are the
    end token alone; a null doc_id counts as empty text for the fold. Without training rows every
    word is unknown. ``score`` is log10 of the product of P(class | previous class) *
    P(word | class); rare classes keep one more type for words never seen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", (fold_of(F.col("doc_id"), 7) == 2).cast("int"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, -(-size // block_bytes))

    def lengths(batches):
        for batch in batches:
            held = batch["held"].to_numpy(zero_copy_only=False)
            n = sum(len(t.split()) + 1 for t, out in zip(A.as_bytes(batch["text"]), held) if not out)
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    tokens = rows.mapInArrow(lengths, "n long").agg(F.sum("n")).first()[0] or 0
    spread = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block").groupBy("block")
    census = spread.applyInArrow(_census(blocks), CENSUS)
    counted = census.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_count(floor), COUNTED)
    encoded = dealt(spread.cogroup(counted.groupBy("block")).applyInArrow(_encode(floor), ENCODED), "block", blocks)

    del spread, census, counted
    free_unused(spark)

    totals = encoded.where("block < 0").select("v", "types", "tokens")
    share = lambda c: lambda t: sum((np.frombuffer(x, np.int64).reshape(-1, TAILS).sum(axis=0) for x in t[c].to_pylist()), np.zeros(TAILS, np.int64))

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(batch["v"].to_pylist())]), *(pa.array([share(c)(batch).tobytes()], pa.binary()) for c in ("types", "tokens"))], names=["v", "types", "tokens"])

    folded = totals.coalesce(1 + blocks // 64).mapInArrow(add, "v long, types binary, tokens binary").toArrow()
    vocabulary, types, rare_tokens = sum(folded["v"].to_pylist()) + (tokens > 0), share("types")(folded), share("tokens")(folded)

    def summed(table, column, kind, length):
        whole = table.coalesce(1 + blocks // 64).mapInArrow(_added(column, kind), "sum binary").toArrow()["sum"].to_pylist()
        return sum((np.frombuffer(x, kind) for x in whole), np.zeros(length, kind))

    def met(state, names, fn, schema):
        """``fn`` over each block with the classes of its words."""
        sent = state.mapInArrow(_deliver, DELIVERED).repartition(blocks, "block").groupBy("block")
        return texts.select(names).groupBy("block").cogroup(sent).applyInArrow(fn, schema)

    texts = encoded.where("block >= 0")
    state = encoded.where("block < 0").select((-1 - F.col("block")).alias("bucket"), F.col("head").alias("words"), F.col("count").alias("counts"),
                                              "class", "users", "uses", "places")
    context = spark.sparkContext
    needed = ["block", "held", "size", "symbols", "head"]
    for turn in range(rounds):  # half of the words at a time, so that neighbours do not swap for ever
        stats = stored(met(state, needed, _contexts(blocks, turn % 2), CONTEXTS))
        bigrams = summed(stats.where("bucket < 0"), "n", np.int64, WIDTH * WIDTH).reshape(WIDTH, WIDTH)
        counts = stats.where("bucket >= 0").repartition(blocks, "bucket").groupBy("bucket")
        state = cut_lineage(state.repartition(blocks, "bucket").groupBy("bucket").cogroup(counts).applyInArrow(_moves(context.broadcast(bigrams)), STATE))
        del stats, counts
        free_unused(spark)
    bigrams = summed(met(state, needed, _contexts(blocks, None), CONTEXTS), "n", np.int64, WIDTH * WIDTH).reshape(WIDTH, WIDTH).astype(float)

    def masses(batches):
        for batch in batches:
            for n, c in zip(batch["counts"].to_pylist(), batch["class"].to_pylist()):
                own = np.bincount(np.frombuffer(c, np.uint8), weights=np.frombuffer(n, np.int64), minlength=CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["mass"])

    mass = summed(state.mapInArrow(masses, "mass binary"), "mass", float, CLASSES)
    of_class = bigrams.sum(axis=0)
    prior = (of_class + 1) / (of_class.sum() + WIDTH)
    transition = np.log10((bigrams + BACKOFF * prior) / (bigrams.sum(axis=1, keepdims=True) + BACKOFF))
    below = np.log10(rare_tokens + types + 1.0)
    model = context.broadcast((transition, mass, below))
    divisor = np.log10(tokens + vocabulary + 1)
    ends = tokens and float(np.log10(of_class[END] + 1))

    def score(key: tuple[pa.Scalar, ...], block: pa.Table, sent: pa.Table) -> pa.Table:
        A.release()  # of the group before
        transition, mass, below = model.value
        row = _block(block)
        of = _classes_of(_by_bucket(row["head"], blocks), sent)
        emit = np.concatenate((np.log10(row["count"] / mass[of[:len(row["head"])]]), -below, [0.0]))
        symbol = row["symbols"]
        cls = of[symbol]
        log = transition[np.concatenate(([END], cls[:-1])), cls] + emit[symbol]
        n = row["size"] + 1
        start = np.cumsum(n) - n
        total = np.add.reduceat(log, start) + row["rare"]
        return pa.table(
            [pa.array(row["doc_id"], mask=row["missing"].astype(bool)), pa.array(row["held"].astype(bool)), pa.array(n),
             pa.array(row["known"] + (1 if ends else 0)), pa.array(np.full(len(n), tokens, np.int64)),
             pa.array(row["base"] + float(ends) - n * divisor), pa.array(total)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    names = ["block", "doc_id", "missing", "held", "size", "known", "base", "rare", "symbols", "head", "count"]
    return met(state, names, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
