"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set is its distinct five-word shingles. SuperMinHash gives each element a permutation of the
signature's places: the element's j-th place gets the rank j plus a fraction, each
place keeps its minimum, and a set stops as soon as no place can still fall below j. The
permutations are the affine ones over a prime number of places, which are uniform for every
place and every pair of places and need no memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import arrays as A
from corpuscope.llm.components import components
from corpuscope.session import cut_lineage, free_unused

SHINGLE, PLACES = 5, 151
#: 30 bands of 5 rows: a pair at 0.85 is missed with probability 2.3e-8, one at 0.8 with 6e-6
BANDS, ROWS = 30, 5
#: owner of a shingle that too many texts of a batch hold
NOBODY = np.iinfo(np.int64).min
#: star rounds before the remaining pairs are looked up by rare shingles
STAR_ROUNDS = 2
#: text bytes whose shingles meet in one task, and those a task combines before it sends them
LONE_BYTES, SENT_BYTES = 8 << 20, 4 << 20

SIGNED = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bands array<long>"
#: a shingle that at most so many texts hold is rare: two texts that share one are met by it
RARE = 64
#: partners of one center that a verification group holds
GROUP_PARTNERS = 512


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by both.

    A-Z count as a-z. Texts with fewer words than ``k`` have their whole sequence as one
    shingle, texts without words none.
    """
    buffer, begin = A.join_texts(texts)
    start, stop = A.word_spans(buffer)
    hashes = A.word_hashes(buffer, start, stop, fold=True)
    edges = np.searchsorted(start, begin)
    counts = np.diff(edges)
    room = np.maximum(counts - k + 1, 0)
    at = A.ranges(edges[:-1], room)
    row = np.repeat(np.arange(len(texts)), room)
    marks = A.word_grams(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    for n in np.unique(counts[short]):
        own = short[counts[short] == n]
        row = np.concatenate((row, own))
        marks = np.concatenate((marks, A.mix(A.word_grams(hashes, int(n))[edges[own]] + np.uint64(n))))
    order = np.lexsort((marks, row))
    row, marks = row[order], marks[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (marks[1:] != marks[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], marks[new]


def signatures(row: np.ndarray, marks: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """``n`` x ``places`` SuperMinHash values; ``places`` is prime. Sets without elements stay at the top value."""
    out = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    p = np.uint64(places)
    step, offset = A.mix(marks ^ np.uint64(0xA5A5)) % (p - np.uint64(1)) + np.uint64(1), A.mix(marks ^ np.uint64(0x3C3C)) % p
    base = row.astype(np.uint64) * p
    live = np.arange(len(row))
    for j in range(places):
        spot = base[live] + (step[live] * np.uint64(j) + offset[live]) % p
        fraction = A.mix(marks[live] + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(16)
        np.minimum.at(out, spot.astype(np.int64), (np.uint64(j) << np.uint64(48)) | fraction)
        top = out.reshape(n, places).max(axis=1) >> np.uint64(48)
        live = live[top[row[live]] > j]
        if not len(live):
            break
    return out.reshape(n, places)


def sign(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint (128 bits) and band hashes of each document."""

    def run(batches):
        for batch in batches:
            texts = A.as_bytes(batch["text"])
            sizes, prints, bands = [], [], []
            for part in A.text_chunks(texts, A.CHUNK_BYTES // 2):
                own = texts[part]
                row, marks = shingle_sets(own)
                count = np.bincount(row, minlength=len(own))
                cuts = np.concatenate(([0], np.cumsum(count)))
                both = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(A.mix(marks + np.uint64(salt)), dtype=np.uint64)))
                    both.append(A.mix(total[cuts[1:]] - total[cuts[:-1]]))
                values = signatures(row, marks, len(own))
                names = np.zeros((len(own), BANDS), np.uint64)
                for r in range(ROWS):
                    names = A.mix(names * np.uint64(31) + values[:, r * BANDS:(r + 1) * BANDS] + np.arange(BANDS, dtype=np.uint64))
                sizes.append(count)
                prints.append(both)
                bands.append(names)
            if not sizes:
                continue
            names = np.concatenate(bands)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * BANDS), pa.array(A.signed(names.ravel())))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(np.concatenate(sizes).astype(np.int64)),
                 *(pa.array(A.signed(np.concatenate([b[i] for b in prints]))) for i in (0, 1)), listed],
                names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "bands"])
        A.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNED)


def _verify(percent: int):
    """Links of a center and its partners: ``100 * common >= percent * union`` on full sets."""

    def run(table: pa.Table) -> pa.Table:
        lead = table["other"].to_numpy(zero_copy_only=False)
        table = table.take(pa.array(np.argsort(lead != 0, kind="stable")))
        texts, ids = A.as_bytes(table["text"]), table["a"].to_numpy()
        partner = table["other"].to_numpy()
        if not len(texts) or partner[0] != 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        center = shingle_sets(texts[:1])[1]
        linked = []
        for part in A.text_chunks(texts[1:], A.CHUNK_BYTES // 2):
            own = texts[1:][part]
            row, marks = shingle_sets(own)
            size = np.bincount(row, minlength=len(own))
            slot = np.minimum(np.searchsorted(center, marks), len(center) - 1)
            common = np.bincount(row, weights=center[slot] == marks, minlength=len(own)).astype(np.int64)
            linked.append(100 * common >= percent * (size + len(center) - common))
        ok = np.flatnonzero(np.concatenate(linked)) + 1 if linked else np.zeros(0, int)
        return pa.table({"a": ids[ok], "b": np.full(len(ok), ids[0])})

    return run


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a, b``) that are similar enough. A center's partners are dealt over as many groups as their number asks."""
    many = pairs.groupBy("b").agg(F.count("*").alias("m"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), 1 + F.floor(F.col("m") / GROUP_PARTNERS)).alias("salt"))
    partners = dealt.join(texts, F.col("a") == F.col("id")).select("b", "salt", "a", F.lit(1).alias("other"), "text")
    centers = dealt.select("b", "salt").distinct().join(texts, F.col("b") == F.col("id")).select(
        "b", "salt", F.col("b").alias("a"), F.lit(0).alias("other"), "text")
    return partners.unionByName(centers).groupBy("b", "salt").applyInArrow(_verify(percent), "a long, b long")


def _owners(texts: DataFrame, buckets: int, most: int) -> DataFrame:
    """Shingles of ``texts`` (``id, label, text``) by bucket, with the texts that hold each.

    A few megabytes of text send a shingle once for each of its owners, or once as nobody's if it has more than ``most``.
    """

    def run(batches):
        for batch in batches:
            own = A.as_bytes(batch["text"])
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            for part in A.text_chunks(own, SENT_BYTES):
                row, marks = shingle_sets(own[part])
                order = np.argsort(marks, kind="stable")
                marks, row = marks[order], row[order] + part.start
                at = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.zeros(0, int)
                n = np.diff(np.append(at, len(marks)))
                many = np.repeat(n > most, n)
                first = np.zeros(len(marks), bool)
                first[at] = True
                sent = ~many | first
                owner = np.where(many, NOBODY, ids[row])[sent]
                label, marks = labels[row][sent], marks[sent]
                home = (marks % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                columns = [x[order] for x in (marks, owner, label)]
                cuts = np.searchsorted(home[order], np.arange(buckets + 1))
                own_cuts = [(b, cuts[b], cuts[b + 1]) for b in np.unique(home).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in own_cuts], pa.int32()), *(pa.array([x[i:j].tobytes() for _, i, j in own_cuts], pa.binary()) for x in columns)],
                    names=["bucket", "marks", "owner", "label"])
        A.release()

    return texts.select("id", "label", "text").mapInArrow(run, "bucket int, marks binary, owner binary, label binary")


def rare_shingles(texts: DataFrame, buckets: int, most: int, pairs: bool = False) -> DataFrame:
    """``a, b, n`` by bucket: with a null ``b``, how many shingles of text ``a`` at most ``most`` of ``texts`` hold; and on request
    for each pair of texts of different labels, how many of these they share."""

    def count(table: pa.Table) -> pa.Table:
        marks, owner, label = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("marks", np.uint64), ("owner", np.int64), ("label", np.int64)))
        order = np.argsort(marks, kind="stable")
        marks, owner, label = marks[order], owner[order], label[order]
        at = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.zeros(0, int)
        n = np.diff(np.append(at, len(marks)))
        rare = (n <= most) & (np.add.reduceat(owner == NOBODY, at) == 0) if len(at) else np.zeros(0, bool)
        ids, lone = np.unique(owner[np.repeat(rare, n)], return_counts=True)
        out = [(ids, np.zeros(len(ids), np.int64), lone, np.ones(len(ids), bool))]
        if pairs:
            met, shared = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            for size in np.unique(n[rare & (n > 1)]):  # all shingles with as many owners
                group = at[rare & (n == size)][:, None] + np.arange(size)
                i, j = np.triu_indices(size, 1)
                for piece in np.array_split(group, 1 + len(group) * len(i) // (1 << 20)):
                    a, b = piece[:, i].ravel(), piece[:, j].ravel()
                    far = label[a] != label[b]
                    new = np.sort(np.stack((owner[a[far]], owner[b[far]]), axis=1), axis=1)
                    met, which = np.unique(np.concatenate((met, new)), axis=0, return_inverse=True)
                    shared = np.bincount(which.ravel(), weights=np.concatenate((shared, np.ones(len(new)))), minlength=len(met))
            out.append((met[:, 0], met[:, 1], shared, np.zeros(len(met), bool)))
        a, b, n, alone = (np.concatenate(c) for c in zip(*out))
        A.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=alone), "n": pa.array(n.astype(np.int64))})

    return _owners(texts, buckets, most).groupBy("bucket").applyInArrow(count, "a long, b long, n long")


def text_buckets(texts: DataFrame) -> int:
    return max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // LONE_BYTES))


def signed_groups(docs: DataFrame, percent: int = 80, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component, component_class`` per row of ``docs``; the component (null for sets without
    elements and null ids) is the smallest doc_id reachable, its class tells components of one id apart.

    Documents with equal sets are one class; classes are numbered in the order of their smallest doc_id. Classes that share a band bucket are
    candidates; they are verified in rounds against one center a bucket, and a pair whose ends
    already are in one component is not looked at again. Two classes of a bucket that still spans components either share a rare
    shingle, which finds them, or have at most their other shingles in common; a pair that could reach the threshold with
    these alone is verified as well. So no candidate is left out.
    """
    signed = cut_lineage(sign(docs))
    grouped = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n_shingles").agg(
        F.min(F.struct("doc_id", "text_hash", "bands")).alias("least")).select("fp1", "fp2", "n_shingles", "least.*")
    classes = cut_lineage(grouped.repartitionByRange("doc_id", "text_hash", "fp1").sortWithinPartitions("doc_id", "text_hash", "fp1")
                          .withColumn("id", F.monotonically_increasing_id()))
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    rows = cut_lineage(rows.join(shared, "bucket"))
    wanted = classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    texts = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("of"), F.xxhash64("text").alias("hash"), "text")
                        .join(wanted, ["of", "hash"]).groupBy("id").agg(F.max("text").alias("text")))
    lone = rare_shingles(texts.withColumn("label", F.col("id")), text_buckets(texts), 1).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("lone"))
    known = cut_lineage(classes.join(rows.select("id").distinct(), "id", "left_semi").join(lone, "id", "left").select(
        "id", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("c")))
    # no partner can share more than the c shingles that are not a text's own: texts that
    # cannot reach the threshold even so leave the bucket
    rows = rows.join(known, "id")
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    rows = rows.join(least, "bucket").where(100 * F.col("c") >= percent * (F.col("n") + F.greatest("least", "c") - F.col("c"))).drop("least")
    rows = cut_lineage(rows.join(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "bucket"))
    labels = rows.select("id", F.col("id").alias("label")).distinct()
    edges = None
    common = F.least("c", "b_c")
    near = 100 * common >= percent * (F.col("n") + F.col("b_n") - common)
    for turn in range(star_rounds + 1):
        marked = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # texts with few shingles of their own are the likely originals of a group: centers
        own = F.floor((F.col("n") - F.col("c")) * (1000 if turn == 0 else 20) / F.col("n"))
        order = F.struct(own.alias("own"), F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_n"), F.col("c").alias("b_c"))
        heads = marked.groupBy("bucket").agg(F.min(order).alias("head"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        if turn < star_rounds:
            # every class meets the best center of its buckets that is in another component
            pairs = marked.join(heads.select("bucket", "head.*"), "bucket").where((F.col("label") != F.col("b_label")) & near)
            pairs = pairs.groupBy("id").agg(F.min_by("b", F.struct("own", "h")).alias("b")).select(F.col("id").alias("a"), "b")
        else:
            pairs = _rest(cut_lineage(marked.join(heads.select("bucket"), "bucket")), texts, percent)
        found = cut_lineage(verify(pairs, texts, percent))
        del marked, heads, pairs
        free_unused(docs.sparkSession)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    least_id = classes.select(F.col("id").alias("component_class"), F.col("doc_id").alias("component"))
    of_class = classes.select("fp1", "fp2", "n_shingles", "id").join(labels, "id", "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("label", "id").alias("component_class")).join(least_id, "component_class")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return signed.drop("bands").join(of_class, ["fp1", "fp2", "n_shingles"], "left").select(
        "doc_id", "text_hash", "n_shingles", *(F.when(usable, F.col(c)).alias(c) for c in ("component", "component_class")))


def _rest(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that may be similar enough, from the buckets that span several (``mixed``: ``bucket, id, label, n``).

    With h common (not rare) shingles each and s rare ones shared, two texts share at most s + min(h, h) shingles.
    """
    members = cut_lineage(mixed.select("id", "label", "n").distinct())
    asked = cut_lineage(texts.join(members.select("id", "label"), "id"))
    rare = cut_lineage(rare_shingles(asked, text_buckets(asked), RARE, pairs=True))
    members = cut_lineage(members.join(rare.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("rare")), "id", "left").select(
        "id", "label", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("h")))

    def reaches(common, n, b_n):
        return 100 * common >= percent * (n + b_n - common)

    ends = [members.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("h").alias(f"{x}_h")) for x in ("a", "b")]
    shared = rare.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("s")).join(ends[0], "a").join(ends[1], "b")
    most = F.least(F.col("s") + F.least("a_h", "b_h"), "a_n", "b_n")
    shared = shared.where(reaches(most, F.col("a_n"), F.col("b_n"))).select("a", "b")
    # pairs without a rare shingle in common; the largest component of a bucket is met, not meeting
    sizes = mixed.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    best = members.groupBy(F.col("label").alias("b_label")).agg(F.max("h").alias("top"), F.min("n").alias("least"))
    meeting = mixed.select("bucket", "id").join(members, "id").where(reaches(F.col("h"), F.col("n"), F.col("h"))).join(main, "bucket").where("label <> main")
    met = meeting.join(sizes.select("bucket", F.col("label").alias("b_label")), "bucket").where(
        "label <> b_label AND (b_label = main OR label < b_label)").select("id", "n", "h", "b_label").distinct()
    limit = F.least("h", "top")
    met = met.join(best, "b_label").where(reaches(limit, F.col("n"), F.greatest("least", limit))).select(F.col("id").alias("a"), "n", "h", "b_label")
    others = members.where(reaches(F.col("h"), F.col("n"), F.col("h"))).select(
        F.col("id").alias("b"), F.col("label").alias("member_of"), F.col("n").alias("b_n"), F.col("h").alias("b_h"))
    common = F.least("h", "b_h")
    plain = met.join(others, (F.col("b_label") == F.col("member_of")) & reaches(common, F.col("n"), F.col("b_n"))).select("a", "b")
    return shared.unionByName(plain).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def group_duplicates(docs: DataFrame, percent: int = 80, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id``, ``text``).

    Sets without elements link with nothing; a null doc_id is its own component (null). Rows of one id with the same set share a
    component, those with other texts have their own; ``kept`` compares ids only.
    """
    return signed_groups(docs, percent, star_rounds).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: the smallest doc_id's, of equal ids one text's, of equal rows one.

    Decided by row, so an id whose rows have different texts loses only those that have a duplicate elsewhere. Rows without words
    or with a null doc_id all stay.
    """
    groups = cut_lineage(signed_groups(docs, percent))
    grouped = groups.where("component_class IS NOT NULL")
    best = grouped.groupBy("component_class").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")).select(
        F.col("best.doc_id").alias("k_id"), F.col("best.text_hash").alias("k_hash"), "component_class")
    rows = grouped.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "component_class").agg(F.count("*").alias("k_rows"))
    kept = rows.join(best, ["k_id", "k_hash", "component_class"]).select("k_id", "k_hash", "k_rows")
    alone = groups.where("component IS NULL").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.lit(1).cast("long").alias("k_rows")).distinct()
    kept = kept.unionByName(alone)
    # columns by their table: those of docs may have any name
    own = [docs[f"`{c}`"] for c in docs.columns]
    left = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["k_id"]) & (F.xxhash64(docs["text"]) == kept["k_hash"]))
    once = left.where(kept["k_rows"] == 1).select(*own)
    several = left.where(kept["k_rows"] > 1).groupBy(kept["k_id"], kept["k_hash"]).agg(F.min(F.struct(*own)).alias("one")).select("one.*")
    return once.unionByName(several)
