"""Steps that must not grow faster than their input: what they sort, store and meet."""

from pyspark.sql import functions as F

from corpuscope.operators import lines as L
from corpuscope.operators.references import references_of
from corpuscope.operators.symbols import brace_candidates, open_headers, structure
from corpuscope.session import ensure_checkpoint_dir, stored


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark, rows):
    return L.files_from(spark.createDataFrame(rows, "source string, path string, text string"), "source", "path", "text")


JAVA = "class A {\n  void f(int a) {\n    g(a);\n    h(a);\n  }\n  int z;\n}\nk(1)\n"
OPEN = "class B {\n  void f(int a)\n  {\n    g(a);\n  }\n  void later(int a)\n  ;\n  void last() { }\n}\n"


def test_references_meet_owners_without_a_sort_of_lines(spark):
    lexed = L.lex_once(_files(spark, [("p", "A.java", JAVA), ("p", "x.go", "no(1)\n"), ("p", "m.py", "y(1)\ndef f():\n    g()\nz()\n")]))
    refs = references_of(lexed, stored(structure(lexed)))
    assert "Window" not in _plan(refs)
    got = {(r.from_symbol, r.to_name, r.line) for r in refs.collect()}
    assert got == {("f", "g", 3), ("f", "h", 4), (None, "k", 8), (None, "no", 1), (None, "y", 1), ("f", "f", 2), ("f", "g", 3), (None, "z", 4)}


def test_semicolons_reach_the_windows_only_below_an_open_header(spark):
    lexed = L.lexed_files(L.lex_once(_files(spark, [("p", "A.java", JAVA), ("p", "B.java", OPEN)])))
    flags = {r.path: r.open_headers for r in lexed.withColumn("open_headers", open_headers()).collect()}
    assert flags == {"A.java": False, "B.java": True}
    found = brace_candidates(L.lines_of(lexed.withColumn("open_headers", open_headers()), "open_headers"))
    got = {(r.name, r.line_no): (r.event_line, r.event_delta, r.event_semi, r.body_end) for r in found.collect()}
    assert got[("f", 2)][0] in (2, 3) and got[("later", 6)] == (7, 0, True, None)


def test_tasks_follow_the_text(spark, monkeypatch):
    lexed = L.lex_once(_files(spark, [("p", f"A{i}.java", JAVA) for i in range(200)]))
    monkeypatch.setattr(L, "TASK_BYTES", 256)
    size = lexed.agg(F.sum("n_bytes")).first()[0]
    assert L.lexed_files(lexed).rdd.getNumPartitions() == -(-size // 256) > 3 * spark.sparkContext.defaultParallelism


def test_stored_rows_are_columns_on_disk(spark):
    rows = spark.range(20000).select("id", F.lit("x" * 200).alias("same"), F.array(F.lit(True)).alias("flags"))
    kept = stored(rows)
    assert kept.columns == rows.columns and kept.agg(F.sum("id")).first()[0] == 199990000
    folder = kept.inputFiles()[0]
    assert ensure_checkpoint_dir(spark).split(":")[-1] in folder
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder.rsplit("/", 1)[0])
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert size < 20000 * 20


def test_scoped_requests_do_not_meet_the_project(spark):
    """Of 300 requests for one name, each with a hit in its own file, none meets another file's declaration."""
    from corpuscope.operators.graph import lookup_symbols

    files = _files(spark, [("p", f"A{i}.java", "") for i in range(300)])
    symbols = files.select("project_id", "file_id", F.lit("f").alias("name"), F.lit("method").alias("kind"), F.lit(None).cast("string").alias("parent_symbol"),
                           F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit("").alias("signature"))
    requests = files.select(F.col("path").alias("request_id"), "project_id", F.lit(" F ").alias("name"), F.col("path").alias("file_path"))
    found = lookup_symbols(requests, symbols, files)
    assert {(r.request_id, r.path) for r in found.collect()} == {(f"A{i}.java", f"A{i}.java") for i in range(300)}
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert "path" in joins and "scoped" not in joins
    loose = lookup_symbols(requests.limit(1).withColumn("file_path", F.lit("none")).unionByName(requests.limit(1).withColumns({"request_id": F.lit(None).cast("string")})), symbols, files)
    assert loose.groupBy("request_id").count().orderBy("request_id").collect()[0]["count"] == 300 and loose.count() == 600


def test_entries_of_many_small_archives_leave_in_few_batches():
    import io
    import zipfile

    import pyarrow as pa

    from corpuscope.sources import readers

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("src/a.py", "x" * 1000)
        archive.writestr(".env", "secret")
    batch = pa.RecordBatch.from_arrays(
        [pa.array([str(i) for i in range(300)]), pa.array([held.getvalue()] * 299 + [b"no archive"])], names=["archive_id", "content"])
    out = list(readers._entries(10_000)(iter([batch])))
    assert len(out) == 1 and out[0].num_rows == 2 * 299 + 1
    assert [r["size"] for r in out[0].slice(0, 2).to_pylist()] == [1000, 6] and out[0].to_pylist()[-1]["error"]
    # large contents are handed on as they come
    assert len(list(readers._entries(10_000)(iter([batch] * 40)))) > 1


def test_calls_stay_with_their_file(spark, monkeypatch):
    """Callers, callees and edges of random calls equal a plain count, with few names or none sent to all tasks, and no call moves for its list."""
    import random

    from corpuscope.operators import graph as G

    rng = random.Random(5)
    files = _files(spark, [("p" if i % 3 else "q", f"A{i}.java", "") for i in range(9)])
    ids = {r.path: (r.project_id, r.file_id) for r in files.collect()}
    declared = [(path, f"{'mM'[i % 2]}{i % 7}", 1 + 70 * i, 60 + 70 * i + 90 * (i % 2)) for path in ids for i in range(rng.randrange(1, 6))]
    calls = [(path, rng.choice(["x.m1", "m2", "M3", "none", "m9", f"one{rng.randrange(99)}", "m5"]), rng.randrange(1, 400)) for path in ids for _ in range(60)]
    symbols = spark.createDataFrame([(*ids[p], n, s, e) for p, n, s, e in declared], "project_id string, file_id string, name string, start_line int, end_line int")
    refs = spark.createDataFrame([(*ids[p], None, n, "call", line, False) for p, n, line in calls] + [(*ids[calls[0][0]], None, "m1", "import", 1, False)],
                                 "project_id string, file_id string, from_symbol string, to_name string, kind string, line int, is_dynamic boolean")
    candidates = symbols.join(files.select("file_id", "path"), "file_id").withColumn("request_id", F.concat_ws("/", "project_id", "name"))

    def key(name):
        return name.split(".")[-1].lower()

    n_declared = {}
    for path, name, *_ in declared:
        at = ids[path][0], key(name)
        n_declared[at] = n_declared.get(at, 0) + 1
    inside = sorted((f"{ids[p][0]}/{n}", p, s, to, line, n_declared.get((ids[p][0], key(to)), 0))
                    for p, n, s, e in declared for q, to, line in calls if p == q and s <= line <= e)
    for hot in (1, 5, 200_000):
        monkeypatch.setattr(G, "HOT_NAMES", hot)
        found = G.callees(candidates, refs, symbols)
        assert "hashpartitioning(request_id" not in _plan(found)
        starts = {(r.request_id, r.candidate): (r.path, r.start_line) for r in
                  G.ranked(candidates, ["request_id"], ["path", "start_line", "end_line"], position="candidate").collect()}
        got = found.collect()
        assert sorted((r.request_id, *starts[r.request_id, r.candidate], r.to_name, r.line, r.candidates) for r in got) == inside
        assert all(r.resolved == (r.candidates > 0) for r in got)
        requests = candidates.select("request_id", "project_id", "name").distinct()
        asked = {(r.request_id, r.project_id, key(r.name)) for r in requests.collect()}
        want = sorted((i, p, line, to) for i, project, name in asked for p, to, line in calls if ids[p][0] == project and key(to) == name)
        listed = G.callers(requests, refs, files).collect()
        assert sorted((r.request_id, r.path, r.line, r.to_name) for r in listed) == want
        by_request = {}
        for r in sorted(listed, key=lambda r: (r.request_id, r.path, r.line, r.to_name)):
            by_request.setdefault(r.request_id, []).append(r.position)
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in by_request.values())
        assert sorted((r.path, r.line, r.to_name, r.candidates) for r in G.call_edges(refs, symbols, files).collect()) == sorted(
            (p, line, to, n_declared.get((ids[p][0], key(to)), 0)) for p, to, line in calls)


def test_files_lexed_once_move_no_more(spark):
    lexed = L.lex_once(_files(spark, [("p", f"A{i}.java", JAVA) for i in range(50)]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = _plan(references_of(lexed, L.dealt_by_file(structure(lexed), L.file_tasks(lexed)[0])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
