"""Golden snippets for the line table, symbols, references, chunks and graph."""

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import chunking as C
from corpuscope.operators import graph as G
from corpuscope.operators.lines import files_from, lexed_files
from corpuscope.operators.references import references_of
from corpuscope.operators.symbols import structure, symbols_of

JAVA = """package a.b;
import java.util.List;
/* comment {
 */
@Deprecated
public class Foo<T> {
    private String x = "{ not";
    // brace { in comment
    public Foo(int a) {
        init(a);
    }
    public void go(String s) throws A {
        util.run(s); other(1);
        Class.forName("x");
    }
    void stub();
    interface Inner {
        default void g() {
            h();
        }
    }
    record R(int a) {
        void notSymbol() {
        }
    }
    enum E { A, B }
}
"""
PYTHON = """# c()
import os, sys
from .pkg import thing
@deco
def top(a):
    \"\"\"doc
    fake(1)
    \"\"\"
    return run(a)  # call(x)

class K(Base):
    \"\"\"d\"\"\"
    x = 1
    @prop
    def m(self): return 1
    @a.b
    @c
    def n(self):
        def inner():
            pass
        return inner()

    y = 2
if x:
    getattr(a, 'b')()
"""
TSX = """import React from 'react';
import './side';
const p = require('path');
export const App = (x) => {
  const inner = () => { foo(); };
  return eval(x);
};
class A {
  m(a: string): void {
    this.go(a);
  }
}
"""
GO = 'package m\r\nimport "fmt"\r\nfunc (d *D) Run(a int) {\r\n\tfmt.Sprint(a)\r\n}\r\n'


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("p", "a/b/Foo.java", JAVA), ("p", "x/k.py", PYTHON), ("p", "w/a.tsx", TSX), ("p", "m/m.go", GO),
            ("p", "x/pkg.py", "def thing():\n    pass\n"), ("p", "empty.java", ""), ("p", "w/side.js", "x = 1\n"),
            ("p", "java.jl/XFoo.java", "class XFoo {\n}\n")]
    files = files_from(spark.createDataFrame(rows, "project string, path string, content string"),
                       "project", "path", "content").cache()
    return files, structure(files).cache()


def _rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_symbols(corpus):
    files, items = corpus
    found = symbols_of(items).join(files.select("file_id", "path"), "file_id")
    got = {p: set() for p in ("a/b/Foo.java", "x/k.py", "w/a.tsx", "m/m.go")}
    for r in found.collect():
        got.setdefault(r.path, set()).add((r.name, r.kind, r.parent_symbol, r.start_line, r.end_line))
    assert got["a/b/Foo.java"] == {
        ("Foo", "class", None, 6, 27), ("Foo", "constructor", "Foo", 9, 11), ("go", "method", "Foo", 12, 15),
        ("Inner", "interface", "Foo", 17, 21), ("g", "method", "Inner", 18, 20), ("R", "record", "Foo", 22, 25),
        ("E", "enum", "Foo", 26, 26)}
    assert got["x/k.py"] == {("top", "function", None, 4, 9), ("K", "class", None, 11, 23),
                             ("m", "function", "K", 15, 15), ("n", "function", "K", 16, 21)}
    assert got["w/a.tsx"] == {("App", "function", None, 4, 7), ("A", "class", None, 8, 12), ("m", "method", "A", 9, 11)}
    assert got["m/m.go"] == {("Run", "function", None, 3, 5)}
    text = {r.name: r.signature for r in found.filter("path = 'x/k.py'").collect()}
    assert text["top"] == "@deco" and text["n"] == "@a.b" and text["m"] == "def m(self): return 1"


def test_references(corpus):
    files, items = corpus
    refs = references_of(files, items).join(files.select("file_id", "path"), "file_id")
    java = _rows(refs.filter("path = 'a/b/Foo.java'"), "line", "to_name", "kind", "from_symbol", "is_dynamic")
    assert java == {
        (2, "java.util.List", "import", None, False), (10, "init", "call", "Foo", False),
        (13, "util.run", "call", "go", False), (13, "other", "call", "go", False),
        (14, "Class.forName", "call", "go", True), (16, "stub", "call", "Foo", False),
        (19, "h", "call", "g", False), (23, "notSymbol", "call", "R", False)}
    python = _rows(refs.filter("path = 'x/k.py'"), "line", "to_name", "kind", "from_symbol")
    assert python == {
        (1, "c", "call", None), (2, "os", "import", None), (3, ".pkg", "import", None), (5, "top", "call", "top"),
        (9, "run", "call", "top"), (11, "K", "call", "K"), (15, "m", "call", "m"), (18, "n", "call", "n"),
        (19, "inner", "call", "n"), (21, "inner", "call", "n"), (25, "getattr", "call", None)}
    strict = references_of(files, structure(files, strict=True), strict=True).join(files.select("file_id", "path"), "file_id")
    kept = _rows(strict.filter("path = 'x/k.py' AND kind = 'call'"), "line", "to_name")
    assert kept == {(9, "run"), (21, "inner"), (25, "getattr")}
    tsx = _rows(refs.filter("path = 'w/a.tsx'"), "line", "to_name", "kind")
    assert tsx == {(1, "react", "import"), (2, "./side", "import"), (3, "path", "import"), (5, "foo", "call"),
                   (6, "eval", "call"), (10, "this.go", "call")}


def test_lexing_rules(spark):
    text = "a /* x\ny */ b\nc = \"// no\" + 'it\\'s' d\n`open\nend // z"
    files = files_from(spark.createDataFrame([("p", "a.ts", text)], "p string, path string, c string"), "p", "path", "c")
    assert lexed_files(files).first().code == ["a ", " b", "c =  +  d", "", "end "]


def test_unbalanced_files_stay_within_bounds(spark):
    rows = [("p", f"f{i}.java", t) for i, t in enumerate([
        "}}\nclass A {\n  void a() {\n  }\n}\n", "class A {\n  void a() {\n    if (x) {\n  }}}\nclass B {\n}\n",
        "class A {\n  void a() {\n", "class A {\nclass A {\n  void b() {\n  }\n}\n}\n"])]
    files = files_from(spark.createDataFrame(rows, "p string, path string, c string"), "p", "path", "c")
    found = symbols_of(structure(files)).join(files.select("file_id", "path"), "file_id")
    by = {}
    for r in found.collect():
        by.setdefault(r.path, set()).add((r.name, r.kind, r.start_line, r.end_line))
    assert by.get("f0.java", set()) == set()  # depth never returns to zero at a header
    assert by["f1.java"] == {("A", "class", 1, 4), ("a", "method", 2, 3), ("B", "class", 5, 6)}
    assert by["f2.java"] == {("A", "class", 1, 2)}
    assert by["f3.java"] == {("A", "class", 1, 6), ("A", "constructor", 2, 5)}


def test_chunks_cover_text_exactly(corpus, spark):
    files, items = corpus
    chunks = C.chunk_files(files, items)
    java = _rows(chunks.filter("path = 'a/b/Foo.java'"), "start_line", "end_line", "chunk_type", "symbol")
    assert (9, 15, "module", "Foo") in java and (26, 26, "enum", "E") in java
    assert chunks.filter("path = 'empty.java'").count() == 0
    for r in chunks.join(files.select("file_id", F.col("content").alias("whole")), "file_id").collect():
        lines = r.whole.replace("\r\n", "\n").split("\n")
        assert r.content == "".join(x + "\n" for x in lines[r.start_line - 1:r.end_line])
        assert r.token_count == len(r.content) // 4


def test_paragraphs_and_overlap(spark):
    long = "\n".join(f"line {i:03d} " + "x" * 90 for i in range(12))
    rows = [("p", "a.md", "h\n\nb\nc\n\n\nz"), ("p", "b.md", long), ("p", "c.md", "y" * 600), ("p", "d.md", "\n".join(["w"] * 100))]
    files = files_from(spark.createDataFrame(rows, "p string, path string, c string"), "p", "path", "c")
    blocks = C.paragraph_blocks(files).select("path", F.inline("blocks"))
    assert _rows(blocks.filter("path = 'a.md'"), "start", "end") == {(1, 2), (3, 5), (6, 7)}
    assert _rows(blocks.filter("path = 'd.md'"), "start", "end") == {(1, 40), (41, 80), (81, 100)}
    pieces = sorted(_rows(C.chunk_files(files).filter("path = 'b.md'"), "start_line", "end_line", "chunk_type"))
    assert pieces[0] == (1, 5, "part") and all(b[0] == a[1] + 1 - 3 for a, b in zip(pieces, pieces[1:]))
    assert _rows(C.chunk_files(files).filter("path = 'c.md'"), "start_line", "end_line") == {(1, 1)}


def test_embeddings_are_unit_and_checked(corpus):
    files, items = corpus
    vectors = C.attach_embeddings(C.chunk_files(files, items), dim=32)
    norms = vectors.select(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 or r.n == 0 for r in norms)
    assert C.wrong_dimension(vectors, 32).isEmpty() and not C.wrong_dimension(vectors, 33).isEmpty()


def test_import_resolution(corpus):
    files, items = corpus
    found = {r.target: (r.resolved_path, r.external) for r in G.resolve_imports(references_of(files, items), files).collect()}
    assert found[".pkg"] == ("x/pkg.py", False)
    assert found["./side"] == ("w/side.js", False)
    assert found["react"] == (None, True)
    assert found["java.util.List"] == (None, False)


def test_java_imports_aligned_and_not(spark):
    files = files_from(spark.createDataFrame(
        [("p", "lib/XFoo.java", "x"), ("p", "a/Main.java", "x"), ("p", "b/c/Z.java", "x")], "p string, path string, c string"), "p", "path", "c")
    main = files.filter("path = 'a/Main.java'").first().file_id
    refs = files.sparkSession.createDataFrame(
        [("p", main, None, t, "import", i, False) for i, t in enumerate(["Foo", "b.c.*", "b.c.Z$Inner", "c.*"])],
        "project_id string, file_id string, from_symbol string, to_name string, kind string, line int, is_dynamic boolean")

    def resolve(**kw):
        return {r.target: r.resolved_path for r in G.resolve_imports(refs, files, **kw).collect()}

    assert resolve() == {"Foo": "lib/XFoo.java", "b.c.*": "b/c/Z.java", "b.c.Z$Inner": "b/c/Z.java", "c.*": None}
    assert resolve(aligned=True)["Foo"] is None


def test_symbol_queries(corpus, spark):
    files, items = corpus
    symbols, refs = symbols_of(items), references_of(files, items)
    asked = spark.createDataFrame([(1, "p", "FOO", None), (2, "p", "in", None), (3, "p", "run", "m/m.go")],
                                  "request_id int, project_id string, name string, file_path string")
    hits = G.lookup_symbols(asked, symbols, files)
    assert _rows(hits, "request_id", "kind") == {(1, "class"), (1, "constructor"), (3, "function")}
    assert _rows(G.similar_names(asked, symbols), "request_id", "name") == {(2, "Inner"), (2, "thing")}
    calls = G.callers(asked, refs, files)
    assert _rows(calls, "request_id", "path", "line", "to_name") == {
        (1, "w/a.tsx", 5, "foo"), (3, "a/b/Foo.java", 13, "util.run"), (3, "x/k.py", 9, "run")}
    inside = G.callees(hits, refs, symbols)
    assert _rows(inside.filter("request_id = 3"), "to_name", "resolved") == {("fmt.Sprint", False)}
    notes = {r.request_id: r.notes for r in G.honesty_notes(asked, hits, calls, inside).collect()}
    assert notes[2] == ["undeclared"] and notes[1][-1] == "several_declarations"
    texts = {(r.path, r.name, r.start_line): r.content for r in G.symbol_sources(symbols, files).collect()}
    whole = {r.path: r.content for r in files.collect()}
    spans = {(r.path, r.name, r.start_line): r.end_line for r in G.symbol_listing(symbols, files).collect()}
    assert texts == {k: "".join(whole[k[0]].splitlines(keepends=True)[k[2] - 1:end]) for k, end in spans.items()}
    linked = G.referenced_by(files.select("project_id", "file_id"), refs, symbols, files).join(files.select("file_id", "path"), "file_id")
    assert ("m/m.go", "a/b/Foo.java") in _rows(linked, "path", "caller_path")
