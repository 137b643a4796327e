"""Metrics, citations, traces and evidence: hand-computed cases."""

import random

from pyspark.sql import functions as F

from corpuscope.operators import citations as CI
from corpuscope.operators import debugging as D
from corpuscope.operators import evaluation as E
from corpuscope.operators.ranks import with_positions


def _metrics(spark, retrieved, relevant, ks=(3,)):
    queries = spark.createDataFrame([("q", len(relevant))], "query_id string, n_relevant int")
    ranked = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate(retrieved)], "query_id string, item string, rank int")
    truth = spark.createDataFrame([("q", p) for p in relevant], "query_id string, item string")
    return E.query_metrics(E.judged(queries, ranked, truth), ks).first().asDict()


def test_metrics(spark):
    m = _metrics(spark, ["a", "b", "c", "d"], {"a", "c"})
    assert abs(m["precision_at_3"] - 2 / 3) < 1e-12 and m["recall_at_3"] == 1 and m["mrr"] == 1 and m["hit_rate_at_3"] == 1
    m = _metrics(spark, ["x", "y", "a"], {"a"}, ks=(2, 5))
    assert m["precision_at_5"] == 1 / 5 and m["hit_rate_at_2"] == 0 and abs(m["mrr"] - 1 / 3) < 1e-12
    m = _metrics(spark, [], {"a"})
    assert m["precision_at_3"] == 0 and m["recall_at_3"] == 0 and m["mrr"] == 0
    m = _metrics(spark, ["a"], set())
    assert m["recall_at_3"] == 0


def test_gate(spark):
    row = spark.createDataFrame([(0.5, 0.2, 1, 10)], "precision_at_5 double, mrr double, failed_questions int, total int")
    found = {r.metric for r in E.gate_breaches(row, {"precision_at_5": 0.5, "mrr": 0.3, "_note": 1.0}).collect()}
    assert found == {"mrr", "failed_questions"}


def test_nearest_rank(spark):
    """Ranks of small, hot, null and empty keys; one key holds most rows and one value many of them."""
    rng = random.Random(5)
    rows = [(f"n{n}", i / 10) for n in (1, 20, 36, 40, 60, 100, 180) for i in range(1, n + 1)]
    rows += [("hot", float(rng.randrange(5000))) for _ in range(12_000)] + [("hot", 7.0)] * 4000
    rows += [(None, 1.0), (None, -2.5), ("void", None), ("huge", 1e300), ("huge", -1e300), ("huge", 0.0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, x double").repartition(7)
    for percent in (5, 50, 95, 100):
        got = {r.key: r.value for r in E.nearest_ranks(frame, "x", percent / 100, ["key"]).collect()}
        assert set(got) == {k for k, _ in rows}
        for key in got:
            own = sorted(x for k, x in rows if k == key and x is not None)
            assert got[key] == (own[-(-percent * len(own) // 100) - 1] if own else 0.0), key
    assert E.nearest_ranks(frame.limit(0), "x", 0.95, ["key"]).count() == 0


def test_positions_of_a_hot_key(spark):
    """A third of the rows has one key; its rows are ranked in many tasks, and the ranks are whole."""
    rng = random.Random(6)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(90)}" if i % 7 else None, rng.randrange(10**6), i) for i in range(60_000)]
    frame = spark.createDataFrame(rows, "key string, x int, tie int").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ranked = with_positions(frame, ["key"], ["x", "tie"], total="n").withColumn("part", F.spark_partition_id())
        got = ranked.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len({r.part for r in got if r.key == "hot"}) >= 16
    want = {}
    for key in {k for k, _, _ in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        want |= {(key, *r): (i + 1, len(own)) for i, r in enumerate(own)}
    assert {(r.key, r.x, r.tie): (r.position, r.n) for r in got} == want


def test_terms_in_lines(spark):
    """Literal terms of any length, special characters and hot grams against a plain scan."""
    rng = random.Random(7)
    words = ["the", "a.b(c)", "ab", "x", "tion", "é", "%", "thesis"]
    files = [("p" if i % 3 else "q", f"f{i}.txt", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(12))) for i in range(30)]
    terms = [("p", t) for t in ("the", "a.b(c) the", "x", "ab", "absent", "é %", "", "thesis ab")] + [("q", "the"), ("r", "the")]
    frame = spark.createDataFrame([(p, p + f, f, c) for p, f, c in files], "project_id string, file_id string, path string, content string")
    asked = spark.createDataFrame(terms * 2, "project_id string, term string")
    got = sorted(map(tuple, D.grep_terms(asked, frame).collect()))
    want = sorted((p, t, f, n + 1) for p, t in terms for q, f, c in files if p == q and t for n, line in enumerate(c.split("\n")) if t in line)
    assert got == want
    first = D.grep_terms(asked, frame, per_term=3).collect()
    assert sorted(map(tuple, first)) == sorted(r for p, t in terms for r in sorted(x for x in want if x[:2] == (p, t))[:3])


def _citations(spark, text, strict=False):
    frame = spark.createDataFrame([(1, text)], "id int, answer string")
    return [(r.cited_path, r.start_line, r.end_line) for r in CI.extract_citations(frame, strict=strict).orderBy("position").collect()]


def test_citation_forms(spark):
    assert _citations(spark, "path.java:120 and router.go (line 45) and `tree.go`") == [
        ("path.java", 120, None), ("router.go", 45, None), ("tree.go", None, None)]
    assert _citations(spark, "a.py:10-20 a.py:30 then a.py (lines 1 - 2)") == [("a.py", 10, 20), ("a.py", 30, None)]
    assert _citations(spark, "see a.tsx") == [("a.ts", None, None)]
    assert _citations(spark, "see a.tsx", strict=True) == [("a.tsx", None, None)]
    assert _citations(spark, "no files") == []


def test_citation_match(one):
    def ok(path, expected):
        return one(CI.matches_expected(F.lit(path), F.array(*[F.lit(e) for e in expected])), x=1)

    assert ok("router.go", ["src/router.go"]) and ok("./src/router.go", ["src/router.go"])
    assert not ok("other/router.go.bak", ["src/router.go"])


def test_tiered_resolution(spark):
    files = spark.createDataFrame([("p", x) for x in ("app.py", "src/app.py", "lib/src/app.py", "b/z.go")], "project_id string, path string")
    asked = spark.createDataFrame([("p", x) for x in ("app.py", "src/app.py", "q\\z.go", "none.c")], "project_id string, cited_path string")
    got = {r.cited_path: (r.path, r.tier, r.n_others) for r in CI.resolve_citations(asked, files).collect()}
    assert got == {"app.py": ("app.py", 1, 2), "src/app.py": ("src/app.py", 1, 1), "q\\z.go": ("b/z.go", 3, 0)}
    others = CI.other_hits(CI.resolve_citations(asked, files), files)
    assert {(r.cited_path, r.other_path) for r in others.collect()} == {
        ("app.py", "src/app.py"), ("app.py", "lib/src/app.py"), ("src/app.py", "lib/src/app.py")}


TRACE = 'Traceback (most recent call last):\n  File "app/services/auth.py", line 42, in login\n    x()\nValueError: bad'


def test_trace(spark):
    traces = spark.createDataFrame([("t", "p", TRACE), ("n", "p", "nothing here")], "trace_id string, project_id string, trace string")
    frame = D.stack_frames(traces).collect()
    assert [(f.file, f.line, f.symbol, f.language) for f in frame] == [("app/services/auth.py", 42, "login", "python")]
    parsed = {r.trace_id: r for r in D.parse_traces(traces).collect()}
    assert parsed["t"].error_type == "ValueError" and parsed["t"].language == "python" and parsed["n"].language is None
    files = spark.createDataFrame([("p", x) for x in ("app/services/auth.py", "zz/myauth.py", "a/myauth.py")], "project_id string, path string")
    found = D.locate_frames(D.dominant_frames(traces), files).collect()
    assert [f.project_path for f in found] == ["a/myauth.py"]  # the unaligned rule takes the first path by order
    aligned = D.locate_frames(D.dominant_frames(traces), files, aligned=True).collect()
    assert [f.project_path for f in aligned] == ["app/services/auth.py"]


def test_mixed_grammars(spark):
    text = "\n".join(["X: boom", "at a.b.C.run(C.java:7)", "at a.b.C.go(C.java)", "at f (/w/app.tsx:3:9)", "\t/go/x/main.go:12 +0x1"])
    traces = spark.createDataFrame([(1, text)], "trace_id int, trace string")
    got = [(f.language, f.file, f.line, f.symbol) for f in D.stack_frames(traces).orderBy("line_no").collect()]
    assert got == [("java", "C.java", 7, "a.b.C.run"), ("java", "C.java", None, "a.b.C.go"),
                   ("javascript", "/w/app.tsx", 3, "f"), ("go", "/go/x/main.go", 12, None)]
    row = D.dominant_language(traces).first()
    assert (row.language, row.frames, row.ignored_frames) == ("java", 2, 2)


def test_clues(spark):
    text = "fails with 'cannot open' and \"cannot open\" KeyError in a/b.py:3 and a/b.py:3, see c.go"
    row = D.extract_clues(spark.createDataFrame([(1, "p", text)], "report_id int, project_id string, description string")).first()
    assert row.error_strings[0] == "cannot open" and row.error_strings.count("cannot open") == 1
    assert row.exc_names == ["KeyError"]
    assert [(x.file, x.line) for x in row.file_lines] == [("a/b.py", "3")] and row.bare_files == ["a/b.py", "c.go"]


def test_clue_limits(spark):
    text = " ".join(f"'text {i}' Err{i:02}Error f{i}.py:{i}" for i in range(30))
    frame = spark.createDataFrame([(1, "p", text)], "report_id int, project_id string, description string")
    frames = spark.createDataFrame([(1, f"a.s{i:02}") for i in range(20)] * 2, "trace_id int, symbol string")
    row = D.extract_clues(frame, frames).first()
    assert [len(row[c]) for c in ("error_strings", "exc_names", "file_lines", "bare_files", "symbols")] == [30, 30, 30, 30, 20]
    cut = D.extract_clues(frame, frames, limits=D.Limits.interactive()).first()
    assert [len(cut[c]) for c in ("error_strings", "exc_names", "file_lines", "bare_files", "symbols")] == [8, 6, 8, 8, 8]
    assert cut.symbols == row.symbols[:8] and cut.error_strings == row.error_strings[:8]


def test_evidence_order(spark):
    rows = [(1, "p", 4, 0, "z.py", 9), (1, "p", 4, 0, "a.py", 30), (1, "p", 4, 1, "a.py", 2), (1, "p", 0, 1, "m.py", 5), (1, "p", 5, 1, "m.py", 1), (1, "p", 3, 0, "n.py", None)]
    frame = spark.createDataFrame(rows, "report_id int, project_id string, source int, seq long, path string, line int")
    got = [tuple(r) for r in D.merge_evidence(frame).select("position", "path", "line", "source").orderBy("position").collect()]
    assert got == [(1, "m.py", 5, 0), (2, "n.py", None, 3), (3, "a.py", 30, 4), (4, "z.py", 9, 4)]
    assert D.merge_evidence(frame, 2).count() == 2


def test_questions(spark):
    rows = [("q1", "r", "x", "locate", ["a.py"], [[1, 3]], ["f", "g"]), ("q2", "r", None, "odd", ["no.py"], [[5, 2]], ["f"]),
            ("q3", "zz", "x", "locate", ["a.py"], None, ["f", "g"]), ("q4", "r", "x", "explain", ["a.py"], [[2, 99]], ["f", "g"])]
    questions = spark.createDataFrame(rows, "id string, repo string, question string, type string, expected_files array<string>, "
                                            "expected_line_ranges array<array<int>>, reference_answer_points array<string>")
    repos = spark.createDataFrame([("r",)], "repo string")
    files = spark.createDataFrame([("r", "a.py", 10)], "repo string, path string, n_lines int")
    got = {(r.question_id, r.problem) for r in E.question_problems(questions, repos, files).collect()}
    assert got == {("q2", "missing required field question"), ("q2", "bad type odd"), ("q2", "needs 2-3 answer points, got 1"),
                   ("q2", "no.py missing"), ("q2", "malformed line range [5, 2]"), ("q3", "unknown repo zz"),
                   ("q4", "range [2, 99] exceeds a.py (10 lines)")}
