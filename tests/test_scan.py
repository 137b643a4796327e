"""The one-pass scan of a file against the same rules over a row a line."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import chunking as C
from corpuscope.operators.lines import files_from, lex_once
from corpuscope.operators.references import references_of
from corpuscope.operators.scan import scan, scan_once
from corpuscope.operators.symbols import structure

LINES = [
    "class A {", "class B(X):", "  def f(self):", "def g(a): return 1", "@deco", "  @a.b(c)", "public void m(int a) {", "void n();", "  void n2(int b)", ";",
    "{", "}", "  }", "} else {", "}}", "/* x", "*/", "// y { ", "# z {", '"""doc', "'''", "'it\\'s {'", '"{" + x', "`tpl", "if (x) {", "foo(1);",
    "a.b.c(2); d . e (3)", "  $x$(1)", "9ab$(q)", "1x(", "éfoo(1)", "foé(1)", "§g(1)", "́h(1)", "éi(1)", "x²y(1)", "Ⅰk(2)",
    "中m(1)", "m中(1)", "import java.util.List;", "import static a.B.*;", "import os", "from .x import y", "  from a importé b",
    "import React, {a } from 'react'", 'import {b} from "./é"', "import './side'", 'const p = require(\'q\') + require( "r" )', "érequire('no')",
    'import "fmt"', 'import f "io" \u0085', "import {c } from 'd'", "func (d *D) Run(a int) {", "func main() {", "export const app = async (x) => {",
    "let z = functioné", "let q = function(a) {", "  key: (a) => b", "m(a: string): void {", "interface I {", "enum E { A, B }", "record R(int a) {",
    "eval(x)", "getattr(a,'b')(1)", "a[0](1)", "x?.(1)", 'Class.forName("x")', "o.apply(1) ; p.call(2)", "", "   ", "\t", "\t\tx = 1", "return f(1)",
    "  return g (2)", "print(x); Len(y); println(z)", "do{", "do (x)", "ifé(x) {", "public static <T> Map<String,List<T>> zz(int a) throws E, F {",
    "@Ann(x) private final int q(int a)", "class", "int x() { ", "go()\r", "\r", "def h(é):", "   class C: pass", "super(1); this.a(2)",
    "async function w() {", "   pass  # c(1)", "x = 'a", "\\", "package a.b;", "* star", "0.5.x(1)", "a\u000b.b(1)", " f(1)", "new Foo(1)",
    "export default class K extends L {",
]


def _odd_files(spark, n):
    rng, rows = random.Random(11), []
    for i in range(n):
        text = rng.choice(["\n", "\n", "\r\n"]).join(
            " " * rng.choice([0, 0, 2, 4, 8]) + rng.choice(LINES) + rng.choice(["", "", "", " ", ";", " {", " }"]) for _ in range(rng.randrange(40)))
        rows.append((f"p{i % 3}", f"f{i}.{rng.choice(['java', 'py', 'ts', 'go', 'jsx', 'md'])}", text + rng.choice(["", "\n", "\n\n"]) if i % 50 else None))
    return files_from(spark.createDataFrame(rows, "s string, path string, c string"), "s", "path", "c").cache()


@pytest.mark.parametrize("strict", [False, True])
def test_a_scan_finds_what_rows_of_lines_do(spark, strict):
    files = _odd_files(spark, 400)
    lexed = lex_once(files, strict)
    items = structure(lexed, strict).cache()
    found = scan(files, strict)

    def same(one, other):
        one, other = sorted(map(repr, one.collect())), sorted(map(repr, other.select(one.columns).collect()))
        assert len(one) > 300 and one == other

    same(items, structure(found))
    same(references_of(lexed, items, strict), references_of(found, structure(found)))
    same(C.chunk_files(files, items, strict, lexed), C.chunk_files(files, strict=strict, scanned=True))
    sizes = {"max_chars": 200, "min_chars": 60, "overlap_lines": 1}
    same(C.chunk_files(files, items, strict, lexed, **sizes), C.chunk_files(files, strict=strict, scanned=True, **sizes))


def test_a_scan_makes_no_row_a_line_and_moves_nothing(spark):
    files = _odd_files(spark, 30)
    refs = references_of(scan(files), structure(scan(files)), keep=("path",))
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    # written once: dealt by file, so grouping by it moves nothing either, and no row is lost
    once = scan_once(files)
    assert once.count() == scan(files).count()
    grouped = references_of(once, structure(once)).groupBy("file_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_large_scans_leave_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from corpuscope.operators import scan as S

    monkeypatch.setattr(S, "BATCH_ROWS", 100)
    batch = pa.RecordBatch.from_pydict({"project_id": ["p"] * 2, "file_id": ["1", "2"], "path": ["a.go", "b.go"], "language": ["go"] * 2,
                                        "content": ["f(1)\n" * 950, "g(1)\n" * 3]})
    out = list(S._scanner(False)(iter([batch])))
    assert max(x.num_rows for x in out) == 100 and sum(x.num_rows for x in out) == 953
    rows = pa.Table.from_batches(out).to_pylist()
    assert {(r["path"], r["start_line"], r["name"]) for r in rows} == {("a.go", i + 1, "f") for i in range(950)} | {("b.go", i + 1, "g") for i in range(3)}


def test_similar_names_gathers_no_postings_and_ranks_a_text_once(spark):
    """Postings of names are many more than the names; neither they nor the lists of names may become a broadcast."""
    from corpuscope.operators import graph as G
    from corpuscope.operators import grams

    names = [(f"p{i % 2}", f"Name{i}x{i % 7}") for i in range(200)]
    symbols = spark.createDataFrame(names, "project_id string, name string")
    asks = [(1, "p0", "ME1"), (2, "p0", "me1"), (3, "p1", "x3"), (3, "p1", "name1"), (3, "p0", "x3"), (4, "p0", "name4x4"), (5, "p1", ""), (6, "p1", "none"),
            (None, "p1", "x5"), (7, "p1", "x5")]
    requests = spark.createDataFrame(asks, "request_id int, project_id string, name string")
    declared = {(p, n.lower()) for p, n in names}
    want = set()
    for i in {a[0] for a in asks}:
        found = {n for j, p, text in asks if j == i and text and (p, text.lower()) not in declared for q, n in names if p == q and text.lower() in n.lower()}
        want |= {(i, n, k) for k, n in enumerate(sorted(found), 1)}
    for few in (grams.FEW, 0):
        grams.FEW, before = few, grams.FEW
        try:
            out = G.similar_names(requests, symbols)
            assert {tuple(r) for r in out.select("request_id", "name", "position").collect()} == want
            plan = out._jdf.queryExecution().executedPlan().toString()
            first = G.similar_names(requests, symbols, 2)
            assert {tuple(r) for r in first.select("request_id", "name", "position").collect()} == {r for r in want if r[2] <= 2}
        finally:
            grams.FEW = before
        if not few:
            assert "project_id" in plan and "BroadcastExchange HashedRelationBroadcastMode(List(input[0, string, true], input[1, string" not in plan
    needles = spark.createDataFrame([("p0", "x3")], "project_id string, needle string")
    texts = symbols.withColumn("low", F.lower("name"))
    met = grams.containing(needles, texts, "project_id", "needle", "low")
    joins = [line for line in met._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    assert joins and all("BuildRight" in line for line in joins) and met.count() == 14


def test_hashed_vectors_are_sums_of_words_and_pairs():
    import zlib

    import numpy as np

    rng = random.Random(3)
    texts = ["", None, "Ä b_1 ÄB", "a"] + [" ".join(rng.choice(["foo", "Bar(a);", "x.y", "é9", "K", "\n"]) for _ in range(60)) for _ in range(20)]
    got = C.hashing_model(48)()(np.array(texts, dtype=object))
    for text, vector in zip(texts, got):
        words, want = __import__("re").findall("[A-Za-z0-9_]+", (text or "").lower()), np.zeros(48, np.float32)
        for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            code = zlib.crc32(token.encode())
            want[code % 48] += 1.0 if code & 0x80000000 else -1.0
        assert vector.dtype == np.float32 and np.array_equal(vector, want / (np.linalg.norm(want) or 1.0))


def test_an_index_is_written_without_rows_of_lines(spark, tmp_path, monkeypatch):
    """Its texts are read by the scan alone; tables are those of the rules over lines."""
    from corpuscope.operators import lines, symbols
    from corpuscope.operators.symbols import symbols_of
    from corpuscope.sources import sinks

    files = _odd_files(spark, 60).filter("content IS NOT NULL")
    lexed = lex_once(files)
    items = structure(lexed).cache()
    want = {"code_symbols": symbols_of(items).collect(), "code_references": references_of(lexed, items).collect(),
            "chunks": C.chunk_files(files, items, lexed=lexed).select("chunk_id", "content", "start_line", "chunk_type").collect()}

    def refused(*args, **more):
        raise AssertionError("rows of lines")

    for module in (lines, symbols):
        monkeypatch.setattr(module, "lines_of", refused)
    sinks.index_projects(files, str(tmp_path / "index"), dim=8)
    for name, rows in want.items():
        got = sinks.read_index(spark, str(tmp_path / "index"), name)
        assert sorted(map(repr, got.select(*rows[0].asDict()).collect())) == sorted(map(repr, rows)), name


def test_requests_for_one_name_are_spread_over_tasks(spark):
    """300 requests that have no hit in their file and ask for one name of one project are not left to one task."""
    from corpuscope.operators import grams
    from corpuscope.operators.graph import lookup_symbols

    symbols = spark.createDataFrame([("p", f"f{i}", "Run", "method", None, i, i + 1, "") for i in range(5)],
                                    "project_id string, file_id string, name string, kind string, parent_symbol string, start_line int, end_line int, signature string")
    files = spark.createDataFrame([("p", f"f{i}", f"{i}.java") for i in range(5)], "project_id string, file_id string, path string")
    requests = spark.range(300).select(F.col("id").alias("request_id"), F.lit("p").alias("project_id"), F.lit("run ").alias("name"), F.lit("none").alias("file_path"))
    for few in (grams.FEW, 0):
        grams.FEW, before = few, grams.FEW
        try:
            found = lookup_symbols(requests, symbols, files)
            assert found.count() == 1500 and found.select("request_id", "path").distinct().count() == 1500
            if few:
                tasks = found.groupBy(F.spark_partition_id()).count().collect()
                assert len(tasks) > 8 and max(r["count"] for r in tasks) < 300
        finally:
            grams.FEW = before
