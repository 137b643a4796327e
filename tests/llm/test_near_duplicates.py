"""Near-duplicate groups against all pairs, and the rows that the pipeline's stages keep."""

import numpy as np
from pyspark.sql import functions as F

from corpuscope.llm import superminhash

WORDS = [f"v{i}" for i in range(500)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute(rows, percent):
    """Component of each row, or None; rows of one id and set are one node."""
    nodes = sorted({(i, shingles(t)) for i, t in rows if i is not None and shingles(t)}, key=lambda x: x[0])
    classes = {}
    for i, s in nodes:
        classes.setdefault(s, i)
    sets = list(classes)
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)), key=lambda k: classes[sets[k]])
                parent[y] = x
    least = {}
    for k, s in enumerate(sets):
        least[root(k)] = min(least.get(root(k), classes[s]), classes[s])
    where = {s: least[root(k)] for k, s in enumerate(sets)}
    return [where.get(shingles(t)) if i is not None else None for i, t in rows]


def check(spark, rows, percent=85):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("id", F.lit("clash"))
    got = superminhash.group_duplicates(frame, percent).collect()
    want = [(i, len(shingles(t)), c if c is not None else i, True if i is None else (c if c is not None else i) == i) for (i, t), c in zip(rows, brute(rows, percent))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def edited(base, seed, edits, vocabulary=None):
    random, w = np.random.default_rng(seed), list(base)
    for j in random.choice(len(w), edits, replace=False):
        w[j] = f"e{seed}x{j}" if vocabulary is None else str(random.choice(vocabulary))
    return " ".join(w)


def test_repeated_ids_with_other_texts(spark):
    a, b = prose(1, 100), prose(2, 100)
    check(spark, [(1, a), (1, b), (2, b + " more"), (3, a), (3, None), (4, b), (None, a), (5, ""), (5, "one"), (6, "ONE")])


def test_family_below_the_threshold(spark):
    """500 texts that share most shingles, none of them similar enough to another, and no original."""
    base = prose(3, 150).split()
    check(spark, [(i, edited(base, i, 3)) for i in range(500)])


def test_family_with_shared_edits(spark):
    """Edits from a small vocabulary, so that texts without an original in reach share rare shingles in chains."""
    base = prose(4, 150).split()
    rows = [(i, edited(base, i, 1 + i % 5, ["red", "green", "blue"])) for i in range(200)]
    rows += [(1000 + i, edited(rows[i][1].split(), 5000 + i, 1)) for i in range(0, 200, 4)]
    check(spark, rows)


def test_parts_of_one_text(spark):
    """Texts of common shingles only: each lacks another piece of a text that is not there."""
    base = prose(5, 240).split()
    check(spark, [(i, " ".join(base[:j] + base[j + 12 + i % 9:])) for i, j in enumerate(range(0, 220, 2))])


def test_rare_shingles_are_exact(spark):
    random = np.random.default_rng(6)
    texts = [" ".join(random.choice(WORDS[:40], 60)) for _ in range(60)] + [prose(7, 40)] * 5
    frame = spark.createDataFrame([(i, i % 7, t) for i, t in enumerate(texts)], "id long, label long, text string")
    got = superminhash.rare_shingles(frame, 8, 4, pairs=True).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    owners = {}
    for i, t in enumerate(texts):
        for s in shingles(t):
            owners.setdefault(s, []).append(i)
    want = {}
    for own in owners.values():
        if len(own) <= 4:
            for a in own:
                want[a, None] = want.get((a, None), 0) + 1
                for b in own:
                    if a < b and a % 7 != b % 7:
                        want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.n for r in got} == want


def test_keep_one_decides_by_row(spark):
    a, b, c, d, e = (prose(seed, 90) for seed in (8, 9, 10, 11, 12))
    rows = [(20, d, "x"), (20, e, "x"), (21, d, "x"), (5, a, "x"), (5, b, "x"), (3, b, "x"), (7, c, "s"), (7, c, "s"), (7, c, "r"), (8, edited(c.split(), 1, 1), "s"),
            (None, a, "x"), (None, None, "x"), (9, None, "x"), (9, "", "x"), (10, "", "x"), (10, "", "x")]
    got = superminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component string"), 80)
    assert got.columns == ["doc_id", "text", "component"]
    want = [(20, d, "x"), (20, e, "x"), (5, a, "x"), (3, b, "x"), (7, c, "r"), (None, a, "x"), (None, None, "x"), (9, None, "x"), (9, "", "x"), (10, "", "x"), (10, "", "x")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_rounds_of_components_free_what_the_driver_holds(spark, monkeypatch):
    from corpuscope.llm import components as module

    freed, free = [], module.free_unused
    monkeypatch.setattr(module, "free_unused", lambda session: (freed.append(1), free(session)))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.label for r in module.components(edges).collect()} == {0}
    assert len(freed) > 1
