"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from corpuscope.llm import arrays as A
from corpuscope.llm import (
    brown, decontaminate, hnsw, licenses, packing, queries, repeats, substrings, suffixes, superminhash, toxicity, urls,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score double, block int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    """Nulls, empty and very long texts, copies, shared passages, ties; with columns named like results."""
    passage = prose(1, 90)
    texts = {1: prose(2, 60), 2: prose(2, 60), 3: None, 4: "", 5: " \t\n", 6: "one two", 7: "one two", 8: "ü é x",
             9: prose(3, 30) + " " + passage + " " + prose(4, 30), 10: passage, 11: prose(5, 20) + "\n" + passage,
             12: "la " * 500, 13: prose(6, 9000), 14: prose(7, 200), 15: "ONE Two"}
    rows = [(i, t, 0.5, 1) for i, t in texts.items()]
    return rows + [rows[8], (None, passage, None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_gone(rows, length):
    first: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - length + 1):
            key = tuple(w[a:a + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if i is not None and first[tuple(w[a:a + length])] < i:
                gone[a:a + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def bytes_gone(rows, length):
    seen: dict = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            seen[b[a:a + length]] += 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if seen[b[a:a + length]] > 1:
                gone[a:a + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings(odd, hot):
    frame = repeats.mark_repeats(odd, substrings.SPEC, True, hot_segments=hot)
    got = frame.collect()
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in got) == words_gone([r[:2] for r in odd_rows()], 13)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert frame.columns[:3] == ["doc_id", "text", "score"]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes(odd, hot):
    got = repeats.mark_repeats(odd, suffixes.SPEC, False, hot_segments=hot).collect()
    assert Counter((r.doc_id, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bytes_gone([r[:2] for r in odd_rows()], 400)


def test_suffixes_keep_first(odd):
    got = {r.doc_id: r.n_removed for r in suffixes.dedup_suffixes(odd, keep_first=True).collect() if r.doc_id}
    assert got[9] == 0 and got[10] > 400 and got[11] > 400 and got[12] == 0


def test_longest_previous():
    text = np.frombuffer(b"abcabcabdabcabc", np.uint8).astype(np.uint16) + 1
    found = suffixes.longest_previous(suffixes.SuffixOrder(text, 8))
    raw = bytes(text.astype(np.uint8) - 1)
    for i in range(len(raw)):
        best = max((next((k for k in range(len(raw) - i + 1) if raw[i:i + k + 1] != raw[j:j + k + 1] or i + k >= len(raw)), 0) for j in range(i)), default=0)
        assert min(found[i], 8) == min(best, 8)


def test_fm_index_counts():
    codes = np.array([1, 2, 1, 2, 3, 0, 1, 2, 3, 1, 0])
    index = substrings.FMIndex(codes, 3)
    low, high = np.array([0]), np.array([len(codes)])
    for symbol in (3, 2, 1):
        low, high = index.extend(low, high, np.array([symbol]))
    assert high[0] - low[0] == 2


def test_empty_tables(spark, none):
    assert substrings.dedup_substrings(none).count() == 0
    assert suffixes.dedup_suffixes(none).count() == 0
    assert superminhash.group_duplicates(none).count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    assert brown.score_texts(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0
    assert hnsw.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    assert toxicity.score_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_superminhash(spark):
    rows = [r[:2] for r in odd_rows()]
    random = np.random.default_rng(3)
    base = prose(9, 120).split()
    for i in range(40):  # a family with few and many edits
        w = list(base)
        for j in random.choice(120, int(random.integers(0, 6)), replace=False):
            w[j] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(w)))
    got = superminhash.group_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_superminhash_estimates():
    marks = A.mix(np.arange(600, dtype=np.uint64))
    row = np.repeat([0, 1], 400)
    values = superminhash.signatures(row, np.concatenate((marks[:400], marks[200:600])), 2)
    assert abs((values[0] == values[1]).mean() - 1 / 3) < 0.12


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    got = packing.pack_documents(odd, path, 256).toPandas()
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for i, text, *_ in odd_rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((-1 if i is None else i, p, low, len(ids[low:low + 256]), zlib.crc32(ids[low:low + 256].tobytes()))
                    for p, low in enumerate(range(0, len(ids), 256)))
    assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == want
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 256
    assert placed.sequence_id.nunique() <= math.ceil(got.length.sum() / 256) + 1


def test_packing_levels(spark):
    sizes = np.random.default_rng(5).integers(1, 257, 3000)
    rows = [(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(sizes)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 256, shard_rows=256).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 256
    assert got.sequence_id.nunique() <= 1.03 * math.ceil(sizes.sum() / 256)


def test_crossover_keeps_every_piece():
    sizes = np.random.default_rng(1).integers(1, 90, 200)
    order = np.argsort(-sizes, kind="stable")
    a = packing.Grouping(sizes, 100).best_fit(order.tolist())
    b = packing.Grouping(sizes, 100).best_fit(range(200))
    child = packing.crossover(a, b, order, np.random.default_rng(2))
    assert sorted(i for m in child.bins for i in m) == list(range(200)) and max(child.fill) <= 100


def test_hnsw(spark):
    random = np.random.default_rng(11)
    base = random.normal(size=(300, 16))
    near = base[:40] + random.normal(scale=0.1, size=(40, 16))
    vectors = [v.tolist() for v in np.concatenate((base, near))]
    rows = list(enumerate(vectors))
    rows += [(900, vectors[0]), (900, vectors[0]), (901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, []), (906, vectors[0][:8]), (None, vectors[0])]
    got = hnsw.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and i < 901]
    sims = np.array([[u @ w for _, w in good] for _, u in good]) >= 0.9
    links = {i: int(sims[k].sum()) - 1 for k, (i, _) in enumerate(good)}
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    assert len(got) == len(rows)
    assert {i: by_id[i].n_links for i in links} == links
    assert by_id[900].component_id == 0 and not by_id[900].kept
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in range(901, 907))


def test_brown_base(spark, odd):
    from binascii import crc32

    got = brown.score_texts(odd).collect()
    held = lambda i: crc32(str(i if i is not None else "").encode()) % 7 == 2
    tokens = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split() + ["end"]) for i, t, *_ in odd_rows()]
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, types = sum(count.values()), len(count)
    want = Counter((i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_exchange_finds_two_vocabularies():
    n = 8
    counts = np.zeros((n, 2, brown.WIDTH), np.int64)
    classes = np.array([0, 1, 0, 1, 1, 0, 1, 0])  # words 0-3 and 4-7 only follow their own kind
    for w in range(n):
        for v in range(4) if w < 4 else range(4, 8):
            counts[w, 0, classes[v]] += 10
            counts[w, 1, classes[v]] += 10
    table = np.zeros((brown.WIDTH, brown.WIDTH))
    for w in range(n):
        table[classes[w]] += counts[w, 1]
    before = classes.copy()
    moved = brown.best_moves(np.arange(n), counts, classes, table)
    assert (classes == before).all() and moved.max() < brown.CLASSES


def test_brown_moves_no_encoded_texts(spark):
    rows = spark.createDataFrame([(i, f"one two w{i % 3} two three") for i in range(40)], "doc_id long, text string")
    plan = brown.score_texts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1  # the classes alone go to the blocks


def test_brown_clusters_rare_words_of_a_large_corpus(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    train, held = [i for i in range(2000) if fold(i) != 2], [i for i in range(2000) if fold(i) == 2]
    kinds = [[f"{kind}{j}zz" for j in range(20)] for kind in "pq"]  # all end alike; a p is followed by a q
    rng = np.random.default_rng(3)
    pairs = lambda n: " ".join(f"{rng.choice(kinds[0])} {rng.choice(kinds[1])}" for _ in range(n))
    rows = [(i, pairs(6)) for i in train[:60]] + [(train[60], "filler " * 2_000_000)]
    tests = {held[0]: ("p", "q"), held[1]: ("q", "q"), held[2]: ("p", "p")}
    rows += [(i, " ".join(f"{k}{j}zz" for j in range(20) for k in pair)) for i, pair in tests.items()]
    got = {r.doc_id: r.score for r in brown.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()}
    assert got[held[0]] > max(got[held[1]], got[held[2]]) + 5


def test_decontamination(spark, odd):
    item = " ".join(prose(1, 90).split()[10:50])
    near = item.split()
    near[20] = "changed"
    items = [(1, item), (2, " ".join(near)), (3, prose(77, 30)), (4, "one two"), (5, None), (6, ""), (None, item)]
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.find_leaks(odd, spark.createDataFrame(items, "item_id long, text string")).collect()}
    m = 36
    assert got == {(d, 1): 1.0 for d in (9, 10, 11, None)} | {(d, 2): round((m - 5) / (m + 5), 6) for d in ()} | {(d, 4): 1.0 for d in (6, 7, 15)}


def test_decontamination_of_documents_shorter_than_an_item(spark):
    item = prose(50, 36)
    cut = lambda a, b: " ".join(item.split()[a:b])
    texts = [(1, cut(0, 33)), (2, cut(2, 36)), (3, cut(0, 20)), (4, "one"), (5, prose(51, 34)), (None, cut(0, 33)), (5, item + " end"), (6, None), (7, prose(52, 9))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item), (None, texts[-1][1])], "item_id long, text string")
    got = {(r.doc_id, r.first_word, r.n_words): round(r.similarity, 6) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 0, 33): round(29 / 32, 6), (None, 0, 33): round(29 / 32, 6), (2, 0, 34): round(30 / 32, 6), (5, 0, 36): 1.0}
    kept = [(r.doc_id, r.text) for r in decontaminate.without_leaks(docs, items).collect()]
    assert kept == [texts[2], texts[3], texts[4], texts[7]]


def test_licenses(spark):
    text = dict(licenses.TEMPLATES)
    rows = [(1, prose(1, 50) + "\n" + text["MIT"] + "\n" + prose(2, 50) + " " + text["GPL-3.0"]), (2, "released under the mit license"), (3, "released under a license"),
            (4, None), (5, ""), (6, text["MIT-text"].replace("free of charge", "at no charge")), (7, text["MIT"] + " " + text["MIT"]), (None, text["MIT"])]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license_id) for r in got) == [(0, "MIT"), (1, "GPL-3.0"), (1, "MIT"), (2, "MIT"), (6, "MIT-text"), (7, "MIT")]
    assert licenses.patience(list("xabcy"), list("abc")) == [(1, 0), (2, 1), (3, 2)]


def test_urls(spark):
    listed = ["http://a.net/x", "HTTP://EXAMPLE.NET/en/1", "https://b.example.com/de/?q", "x://org/fr/", "x://orgs/fr/", "no scheme", None, "http://c.net", "http://example.net/en"]
    rows = list(enumerate(listed)) + [(0, listed[0]), (None, listed[0])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.RULES).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by_id[1] == ("example.net", "/en/1", "example.net/en/", "allow") and by_id[2][2:] == ("example.com/de/", "block")
    assert by_id[3][2:] == ("org/fr/", "allow") and by_id[4][2:] == (None, "allow") and by_id[5][:3] == by_id[6][:3] == ("", "", None)
    assert by_id[7][2] is None and by_id[8][2] == "net/" and by_id[0] == ("a.net", "/x", "net/", "block")
    globs = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("*/x", "block")]).where("rule IS NOT NULL")
    assert {r.page_id for r in globs.collect()} == {0, None}
    odd = urls.judge_urls(spark.createDataFrame([(1, "http://a.com/x.net /net")], "page_id long, url string"), urls.RULES).first()
    assert odd.rule is None and odd.verdict == "allow"
    with pytest.raises(ValueError):
        urls.rule_table(spark, [("net/", "maybe")])


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    caught = got.score >= 0.3
    assert (caught & (got.toxic == 1)).sum() >= 6 and (caught & (got.toxic == 0)).sum() <= 2


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert isinstance(after.schema, T.StructType) and 0 < after.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).count() > 100
