"""Limiter, job state, conversations, retrieval and sinks."""

import datetime as dt
import io
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import conversations as CV
from corpuscope.operators import hygiene as H
from corpuscope.operators import jobs as J
from corpuscope.operators import reading as RD
from corpuscope.operators import retrieval as R
from corpuscope.operators import transitions as TR
from corpuscope.operators.ratelimit import rate_limit
from corpuscope.operators.transitions import job_states

START = dt.datetime(2024, 1, 1)


def _brute(rows, limits, window):
    out, state = {}, {}
    for rid, caller, bucket, ms in sorted(rows, key=lambda r: (r[3], r[0])):
        start, used = state.get((caller, bucket), (None, 0))
        if start is None or ms - start >= window:
            start, used = ms, 0
        state[caller, bucket] = start, used + 1
        out[rid] = (used + 1, used + 1 <= limits[bucket])
    return out


def test_limiter_with_a_hot_caller(spark):
    rng = random.Random(3)
    rows, ms = [], 1_704_067_200_000
    for i in range(6000):
        ms += rng.choice([0, 1, 40, 700, 2500]) if i % 500 else 70_000
        rows.append((i, "hot" if rng.random() < 0.6 else f"u{rng.randrange(40)}", rng.choice(["AUTH", "CHAT"]), ms))
    frame = spark.createDataFrame(rows, "request_id long, caller string, bucket string, ms long").select(
        "request_id", "caller", "bucket", F.timestamp_millis("ms").alias("ts")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the hot caller cut
    try:
        got = {r.request_id: (r.request_no, r.allowed) for r in rate_limit(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _brute(rows, {"AUTH": 5, "CHAT": 20}, 60_000)


def test_limiter_denies_the_21st(spark):
    rows = [(i, "u", "CHAT", START + dt.timedelta(seconds=i)) for i in range(21)] + [(99, "u", None, START)]
    got = rate_limit(spark.createDataFrame(rows, "request_id long, caller string, bucket string, ts timestamp")).collect()
    denied = [r for r in got if not r.allowed]
    assert [r.request_id for r in denied] == [20] and denied[0].retry_after_s == 40 and len(got) == 21


def _events(spark, rows):
    return spark.createDataFrame([(1, i, START + dt.timedelta(seconds=s), e, p) for i, (s, e, p) in enumerate(rows)],
                                 "job_id long, event_id long, ts timestamp, event string, percent int")


def test_job_life(spark):
    events = _events(spark, [(0, "enqueue", 0), (5, "claim", 0), (9, "heartbeat", 30), (10, "heartbeat", 40), (20, "fail", 0),
                             (50, "claim", 0), (81, "claim", 0), (90, "complete", 0), (95, "cancel", 0)])
    for partitions in (None, 1, 5):
        row = job_states(events, partitions=partitions).first()
        assert (row.status, row.attempts, row.progress_percent) == ("ready", 2, 100)
        assert row.next_run_at == START + dt.timedelta(seconds=80)  # first retry after 60 s


def test_job_stale_and_cancel(spark):
    events = _events(spark, [(0, "enqueue", 0), (1, "claim", 0), (200, "heartbeat", 7), (400, "requeue", 0), (501, "requeue", 0),
                             (502, "cancel", 0), (503, "fail", 0)])
    for partitions in (None, 1, 5):
        row = job_states(events, partitions=partitions).first()
        assert (row.status, row.attempts, row.progress_percent) == ("cancelled", 1, 7)
        assert row.next_run_at == START + dt.timedelta(seconds=501)


KINDS = ("enqueue", "claim", "heartbeat", "complete", "cancel", "fail", "requeue")


def _log(rng, n):
    """Events with gaps around the lease and the backoff, some kinds rare."""
    weights, ms, out = [rng.random() ** 3 for _ in KINDS], 0, []
    weights[4] *= 0.1
    for _ in range(n):
        ms += rng.choice([0, 1000, 20_000, 60_000, 120_000, 300_000, 301_000, 400_000])
        out.append((rng.choices(KINDS, weights)[0], ms, rng.randrange(100)))
    return out


def test_maps_of_runs_compose():
    """A log cut anywhere and put together by its maps gives the state of the whole."""
    rng, rules = random.Random(11), TR.Rules(3, 300)
    for _ in range(800):
        log, state, at = _log(rng, rng.randrange(1, 60)), TR.NONE, 0
        while at < len(log):
            run, pieces = log[at:at + rng.randrange(1, 12)], {}
            for status, attempts, upto, after in TR.describe(rules, run):
                pieces.setdefault((status, attempts), []).append((upto, after))
            state, at = TR.follow(rules, pieces, state), at + len(run)
        assert state == TR.fold(rules, log)


def test_job_states_with_a_hot_job(spark):
    """One job holds half of the log and spans many partitions."""
    rng, rules = random.Random(12), TR.Rules(3, 300)
    logs = {0: _log(rng, 3000)} | {j: _log(rng, rng.randrange(1, 60)) for j in range(1, 100)}
    rows = [(j, i, START + dt.timedelta(milliseconds=ms), e, p if p % 9 else None) for j, log in logs.items() for i, (e, ms, p) in enumerate(log)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, event string, percent int").repartition(6)
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    want = {}
    for j, log in logs.items():
        status, attempts, progress, due, locked = TR.fold(rules, [(e, base + ms, p if p % 9 else 0) for e, ms, p in log])
        want[j] = (status, attempts, progress, due, locked)

    def milli(t):
        return None if t is None else int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    for partitions in (1, 40):
        got = {r.job_id: (r.status, r.attempts, r.progress_percent, milli(r.next_run_at), milli(r.locked_at)) for r in job_states(frame, partitions=partitions).collect()}
        assert got == want
    assert job_states(frame.limit(0)).count() == 0


def test_uploads_are_idempotent(spark):
    jobs = spark.createDataFrame([("j1", "p", "h", "ready", START), ("j2", "p", "h", "error", START + dt.timedelta(1))],
                                 "job_id string, project_id string, content_hash string, status string, created_at timestamp")
    uploads = spark.createDataFrame([(1, "p", "h"), (2, "p", "new"), (3, "p", "new")], "upload_id int, project_id string, content_hash string")
    got = {r.upload_id: (r.job_id, r.reused) for r in J.match_uploads(uploads, jobs).collect()}
    assert got[1] == ("j1", True) and got[2][1] is False and got[3] == (got[2][0], True)


def test_history_rules(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(12)]
    messages = spark.createDataFrame([(1, i, str(i), r, c) for i, (r, c) in enumerate(turns)],
                                     "conv_id int, seq int, message_id string, role string, content string")
    conv = spark.createDataFrame([(1, "sum", "2")], "conv_id int, summary string, summary_through_id string")
    live = CV.live_history(messages, conv)
    assert live.count() == 9

    def window(question, regenerate):
        asked = spark.createDataFrame([(1, question, regenerate)], "conv_id int, question string, regenerate boolean")
        return [(r.role, r.content) for r in CV.history_window(live, asked, conv).orderBy("seq").collect()]

    assert window("other", False)[0] == ("system", "Earlier discussion summary: sum")
    assert [c for _, c in window("other", False)][1:] == [f"m{i}" for i in range(4, 12)]
    assert [c for _, c in window(" m10 ", True)] == [f"m{i}" for i in range(3, 10)]  # answer and question dropped, no summary


def test_trim_stubs_oldest_results(spark):
    stub = CV.TOOL_RESULT_STUB
    rows = [(1, 0, "user", "q" * 50), (1, 1, "tool", "a" * 100), (1, 2, "tool", "b"), (1, 3, "tool", "c" * 100), (1, 5000, "tool", "d" * 100)]
    messages = spark.createDataFrame(rows, "run_id int, seq int, role string, content string")

    def brute(budget):
        size, out = sum(len(r[3]) for r in rows), set()
        for r in rows:
            if size <= budget:
                break
            if r[2] == "tool":
                size -= len(r[3]) - len(stub)
                out.add(r[1])
        return out

    for budget in (400, 350, 300, 250, 200, 100):
        got = {r.seq for r in CV.trim_to_budget(messages, budget=budget).filter("stubbed").collect()}
        assert got == brute(budget)


def _cosines(rows):
    x = np.array([v for _, v in rows], float)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norms == 0, 1, norms)
    return np.round(x @ x.T, 9)


def test_topk_in_small_tiles(spark):
    """Blocks of a few queries and tiles of a few values give the exact lists; copies of a vector tie by id."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(120)] + [(500, [0.0] * 16)]
    schema = "chunk_id long, embedding array<float>, scope string"
    scope = {i: f"s{i % 3}" if i % 5 else None for i, _ in rows}
    chunks = spark.createDataFrame([(i, v, scope[i]) for i, v in rows] + [(999, None, "s1")], schema).repartition(5)
    asked = [i for i, _ in rows if i < 40 or i == 500]
    queries = chunks.filter(F.col("chunk_id").isin(asked)).withColumnRenamed("chunk_id", "query_id")
    score, ids = _cosines(rows), [i for i, _ in rows]

    def brute(scoped):
        out = set()
        for a, query in enumerate(ids):
            if query in asked:
                near = [(-score[a][b], c) for b, c in enumerate(ids) if c != query and (not scoped or scope[c] is not None and scope[c] == scope[query])]
                out |= {(query, c, n + 1) for n, (_, c) in enumerate(sorted(near)[:5])}
        return out

    for sizes in ({}, {"block_bytes": 1000, "tile_bytes": 2000}, {"tile_bytes": 8}):
        got = R.vector_topk(queries.drop("scope"), chunks.drop("scope"), 5, True, **sizes)
        assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == brute(False)
    got = R.vector_topk(queries, chunks, 5, True, block_bytes=1000, tile_bytes=2000)
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == brute(True)
    assert R.vector_topk(queries.limit(0), chunks, 5).count() == 0


def test_learned_cells(spark, tmp_path):
    """Cells grow with the rows; audited queries find nine tenths of their exact lists, reading few cells where vectors cluster."""
    counts = []
    for size, spread in ((400, 1.0), (3000, 0.15)):
        random_ = np.random.default_rng(size)
        centers = random_.standard_normal((30, 16))
        x = centers[random_.integers(0, 30, size)] + spread * random_.standard_normal((size, 16))
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
        queries = chunks.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
        folder = str(tmp_path / f"cells{size}")
        R.build_cells(chunks, folder)
        R.audit_cells(queries, folder, 10, exclude_self=True)
        vectors, learned = R.read_cells(spark, folder)
        counts.append(len(learned))
        assert vectors.count() == size
        score = _cosines(rows)
        found = {}
        for r in R.approximate_topk(queries, folder, 10, exclude_self=True, block_bytes=4000).collect():
            found.setdefault(r.query_id, set()).add(r.chunk_id)
        for query in range(0, size, 20):
            exact = sorted((c for c in range(size) if c != query), key=lambda c: (-score[query][c], c))[:10]
            assert len(found[query] & set(exact)) >= 9
    assert counts[0] == R.cell_count(400) < counts[1] == R.cell_count(3000)


def test_registered_approximate_search_reaches_recall(spark, monkeypatch):
    from corpuscope.plans import load_all
    from corpuscope.plans.registry import QUERIES

    load_all()

    folder = "/root/testdata/sf0.01"
    by_query = lambda rows: {q: {r.chunk_id for r in rows if r.query_id == q} for q in {r.query_id for r in rows}}
    exact = by_query(QUERIES["vector_topk_batch"](spark, folder).collect())

    def check():
        near = by_query(QUERIES["vector_topk_approximate"](spark, folder).collect())
        assert len(near) == len(exact) and all(len(near[q] & exact[q]) >= 0.9 * len(exact[q]) for q in exact)

    check()
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 8 * 64 * 40)  # queries in blocks
    check()


def test_read_and_grep(spark):
    from corpuscope.operators.lines import files_from

    files = files_from(spark.createDataFrame([("p", "a.py", "x\nbar (1)\ny"), ("p", "b.py", "bar(2)\n")], "p string, path string, c string"), "p", "path", "c")
    hits = RD.grep(files, r"bar\s*\(").collect()
    assert {(h.path, h.line, h.text) for h in hits} == {("a.py", 2, "bar (1)"), ("b.py", 1, "bar(2)")}
    for wrong in ("(", "(?P<n>a)", ""):
        with pytest.raises(ValueError):
            RD.grep(files, wrong)
    asked = spark.createDataFrame([(1, "p", "a.py", 2, 9), (2, "p", "a.py", None, None)],
                                  "request_id int, project_id string, path string, start_line int, end_line int")
    got = {r.request_id: r for r in RD.read_ranges(asked, files, max_lines=2).collect()}
    assert got[1].content == "bar (1)\ny" and got[1].end_line == 9 and not got[1].truncated
    assert got[2].content == "x\nbar (1)\n" and got[2].truncated and got[2].shown == 2


def test_archive_limits(spark):
    def verdict(entries, **kw):
        frame = spark.createDataFrame([("a", i, p, s) for i, (p, s) in enumerate(entries)], "archive_id string, entry_no int, path string, size long")
        return H.archive_verdicts(frame, **kw).first().rejected

    assert verdict([("a.py", 10), ("x.png", 10 ** 9)]) is None
    assert verdict([("a.py", 1_000_001)]) == "file_too_large"
    assert verdict([("a.py", 6), ("b.py", 6)], max_total=10) == "archive_too_large"
    assert verdict([("a.py", 1), ("b.py", 1)], max_files=2) is None
    assert verdict([("a.py", 1), ("b.py", 1), ("x.png", 1)], max_files=2) == "too_many_files"


def test_ingest_reindex_and_purge(spark, tmp_path):
    from corpuscope.sources.readers import list_tree, read_tree, source_files
    from corpuscope.sources.sinks import index_projects, purge_projects, read_index
    from corpuscope.streaming.ingest import ingest

    uploads, index = tmp_path / "up", str(tmp_path / "idx")
    for project, body in (("p1", "class A {\n  void m() {\n    go();\n  }\n}\n"), ("p2", "def f():\n    pass\n")):
        os.makedirs(uploads / project)
        with zipfile.ZipFile(uploads / project / "a.zip", "w") as z:
            z.writestr("src/A.java" if project == "p1" else "f.py", body)
            z.writestr(".env", "S")
            if project == "p2":
                z.writestr("bad.py", b"\xff")
    ingest(spark, str(uploads), index, str(tmp_path / "ck")).awaitTermination()

    def table(name):
        return read_index(spark, index, name)

    assert {r.name for r in table("code_symbols").collect()} == {"A", "m"}
    assert {(r.project_id, r.path) for r in table("failed_files").collect()} == {("p2", "bad.py")}
    tree = tmp_path / "tree" / "p1"
    os.makedirs(tree / "d")
    (tree / "d" / "n.md").write_text("# only text\n")
    assert [(r.project_id, r.path) for r in list_tree(spark, str(tmp_path / "tree")).collect()] == [("p1", "d/n.md")]
    files = source_files(read_tree(spark, str(tmp_path / "tree"))).drop("error")
    other = files.withColumn("project_id", F.lit("p3"))
    index_projects(files.unionByName(other), index)
    assert {r.path for r in table("files").collect()} == {"d/n.md"} and table("code_symbols").count() == 0
    purge_projects(spark, index, spark.createDataFrame([("p1",)], "project_id string"))
    assert {r.project_id for r in table("chunks").collect()} == {"p3"}


def test_listing_a_tree_takes_few_tasks(spark, tmp_path):
    """tasks of a listing do not grow with the folders; before, each folder was one."""
    from corpuscope.sources.readers import list_tree

    n = 5 * spark.sparkContext.defaultParallelism + 40
    for i in range(n):
        os.makedirs(tmp_path / "p" / f"d{i}")
        (tmp_path / "p" / f"d{i}" / "a.md").write_text("x")
    name, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    try:
        tree = list_tree(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(name) == before
    assert {(r.project_id, r.path) for r in tree.collect()} == {("p", f"d{i}/a.md") for i in range(n)}


def test_ingest_failures_and_repair(spark, tmp_path):
    """Broken, oversized, repaired and failing-again uploads, and the order of two uploads."""
    from corpuscope.sources.sinks import read_index
    from corpuscope.streaming.ingest import index_batch, read_uploads

    index, good = str(tmp_path / "idx"), b"def f():\n    pass\n"

    def blob(*entries):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, body in entries:
                z.writestr(name, body)
        return held.getvalue()

    def run(*rows):
        index_batch(spark.createDataFrame(list(rows), "project_id string, archive_id string, modificationTime timestamp, content binary"), index)
        files = {(r.project_id, r.path) for r in read_index(spark, index, "files").collect()}
        return files, {(r.project_id, r.path, r.error) for r in read_index(spark, index, "failed_files").collect()}

    at = lambda day: dt.datetime(2024, 1, day)
    broken = bytearray(blob(("a.py", good), ("b.py", good)))
    broken[broken.rfind(b"def f")] ^= 1  # the second entry's checksum fails
    files, failed = run(("p1", "a.zip", at(1), bytes(broken)), ("p2", "a.zip", at(1), blob(("big.py", b"x" * 1_000_001))),
                        ("p3", "v9.zip", at(1), blob(("old.py", good))), ("p3", "v10.zip", at(2), blob(("new.py", good))))
    assert files == {("p3", "new.py")}
    assert failed == {("p1", None, "archive broken"), ("p2", None, "archive file_too_large")}
    files, failed = run(("p1", "b.zip", at(3), blob(("a.py", good))), ("p3", "v11.zip", at(3), blob(("bad.py", b"\xff"))))
    assert files == {("p1", "a.py")}
    assert failed == {("p2", None, "archive file_too_large"), ("p3", "bad.py", "malformed UTF-8")}
    files, failed = run(("p1", "old.zip", at(2), blob(("stale.py", good))), ("p1", "older.zip", at(1), blob(("stale.py", good))))
    assert files == {("p1", "a.py")}  # an upload older than the indexed one changes nothing
    log = {(r.project_id, r.archive_id): r.outcome for r in read_uploads(spark, index).collect()}
    assert log == {("p1", "a.zip"): "failed", ("p2", "a.zip"): "failed", ("p3", "v9.zip"): "superseded", ("p3", "v10.zip"): "ready",
                   ("p1", "b.zip"): "ready", ("p3", "v11.zip"): "failed", ("p1", "old.zip"): "late", ("p1", "older.zip"): "superseded"}


def _plain_files(spark, rows):
    frame = spark.createDataFrame(rows, "project_id string, path string, content string")
    return frame.select("project_id", F.md5(F.concat_ws("/", "project_id", "path")).alias("file_id"), "path", "content", F.md5("content").alias("content_hash"),
                        F.octet_length("content").cast("long").alias("size_bytes"), F.lit("python").alias("language"))


def test_failed_write_keeps_the_old_index(spark, tmp_path, monkeypatch):
    from corpuscope.sources import sinks

    index = str(tmp_path / "idx")
    old = [("p1", "a.py", "def f():\n    pass\n"), ("p2", "b.py", "def g():\n    pass\n")]
    sinks.index_projects(_plain_files(spark, old), index)

    def state():
        return ({(r.project_id, r.path) for r in sinks.read_index(spark, index, "files").collect()},
                {r.name for r in sinks.read_index(spark, index, "code_symbols").collect()})

    before = state()
    assert before == ({("p1", "a.py"), ("p2", "b.py")}, {"f", "g"})
    write = sinks.write_version

    def broken(df, folder, name, version):
        if name == "code_references":
            raise OSError("disk full")
        write(df, folder, name, version)

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_version", broken)
        with pytest.raises(OSError):
            sinks.index_projects(_plain_files(spark, [("p1", "new.py", "def h():\n    pass\n")]), index)
    assert state() == before
    sinks.index_projects(_plain_files(spark, [("p1", "new.py", "x = 1\n")]), index)
    assert state() == ({("p1", "new.py"), ("p2", "b.py")}, {"g"})
    assert len(os.listdir(f"{index}/files")) == 3
    sinks.compact(spark, index)
    assert state() == ({("p1", "new.py"), ("p2", "b.py")}, {"g"}) and len(os.listdir(f"{index}/files")) == 1


def test_limiter_calls_the_state_store_once_a_key_and_batch():
    """a key's batch reads its window once and writes it, and sets a timer, only where it changed."""
    from pyspark.sql import Row

    from corpuscope.streaming.limiter import AnchoredWindow

    class Store:
        value, calls = None, []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, _):
            self.calls.append("timer")

        def getCurrentWatermarkInMs(self):
            return 50

    store, window = Store(), AnchoredWindow({"CHAT": 1}, 100)
    window.init(store)

    def batch(*rows):
        store.calls.clear()
        return [tuple(r) for r in window.handleInputRows(("u:CHAT",), iter([Row(request_id=i, bucket="CHAT", ms=ms) for i, ms in rows]), store)], list(store.calls)

    assert batch((2, 150), (1, 60), (3, 40), (4, None)) == ([
        ("u:CHAT", 3, "CHAT", None, None, None, None, True), ("u:CHAT", 4, "CHAT", None, None, None, None, True),
        ("u:CHAT", 1, "CHAT", 60, 1, True, None, False), ("u:CHAT", 2, "CHAT", 60, 2, False, 1, False)], ["get", "update", "timer"])
    assert batch((5, 159)) == ([("u:CHAT", 5, "CHAT", 60, 3, False, 1, False)], ["get", "update"])
    assert batch((6, 10)) == ([("u:CHAT", 6, "CHAT", None, None, None, None, True)], ["get"])


def test_files_of_an_index_do_not_grow_with_its_projects(spark, tmp_path):
    """two hundred small projects are a few files in order of the project, not a folder each."""
    import glob

    from corpuscope.sources import sinks

    index = str(tmp_path / "idx")
    sinks.index_projects(_plain_files(spark, [(f"p{i}", "a.py", f"def f{i}():\n    pass\n") for i in range(200)]), index)
    for table in sinks.TABLES:
        assert 0 < len(glob.glob(f"{index}/{table}/**/*.parquet", recursive=True)) <= spark.sparkContext.defaultParallelism
    for part in glob.glob(f"{index}/files/**/*.parquet", recursive=True):
        projects = [r.project_id for r in spark.read.parquet(part).collect()]
        assert projects == sorted(projects)
    assert {(r.project_id, r.name) for r in sinks.read_index(spark, index, "code_symbols").collect()} == {(f"p{i}", f"f{i}") for i in range(200)}


def test_second_of_two_writers_fails(spark, tmp_path):
    from corpuscope.sources import sinks

    index = str(tmp_path / "idx")
    base = sinks.published(spark, index)
    projects = spark.createDataFrame([("p1",)], "project_id string")
    sinks.publish(spark, index, sinks.entries_of(projects, "v1"), projects, base)
    with pytest.raises(sinks.IndexConflict):
        sinks.publish(spark, index, sinks.entries_of(projects, "v2"), projects, base)
    assert [r.version for r in sinks.read_manifest(spark, index).collect()] == ["v1"]
    assert sinks.read_index(spark, index, "files").count() == 0


def test_late_rows_are_told(spark, tmp_path):
    """Rows behind the watermark change nothing; requests come out as late, events are counted."""
    from corpuscope.streaming.lifecycle import stream_job_states
    from corpuscope.streaming.limiter import stream_rate_limit

    def drain(name, schema, files, build, mode="update"):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        seen = []
        build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))).writeStream.outputMode(mode) \
            .foreachBatch(lambda batch, _: seen.extend(batch.collect())).option("checkpointLocation", str(tmp_path / f"{name}-ck")) \
            .trigger(availableNow=True).start().awaitTermination()
        return seen

    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    files = [[(10 * n + i, "u", "CHAT", at(m)) for i, m in enumerate(minutes)] for n, minutes in enumerate(([0, 60, 120], [121, 5, 6], [130]))]
    seen = drain("requests", "request_id long, caller string, bucket string, ts timestamp", files, stream_rate_limit, "append")
    assert {r.request_id: (r.late, r.request_no) for r in seen} == {
        0: (False, 1), 1: (False, 1), 2: (False, 1), 10: (False, 1), 20: (False, 1), 11: (True, None), 12: (True, None)}
    files = [[(1, 0, at(0), "enqueue", 0), (1, 1, at(60), "claim", 0), (1, 2, at(62), "heartbeat", 5)], [(1, 3, at(3), "cancel", 0), (1, 4, at(63), "heartbeat", 9)]]
    seen = drain("events", "job_id long, event_id long, ts timestamp, event string, percent int", files, stream_job_states)
    last = max(seen, key=lambda r: r.at_ms)
    assert (last.status, last.progress_percent, last.late_events) == ("processing", 9, 1)
