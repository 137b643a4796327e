"""Registered queries: conversations, jobs, request limits and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import text as TX
from corpuscope.operators import conversations as CV
from corpuscope.operators import evaluation as E
from corpuscope.operators import jobs as J
from corpuscope.operators import ratelimit as RL
from corpuscope.operators.transitions import job_states
from corpuscope.plans.registry import Tables, query

NOW = "2024-01-20 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


# ---- conversations ------------------------------------------------------------
# long conversations: the given ones are chained ten to one

MESSAGES_SQL = """
messages AS MATERIALIZED (SELECT conv_id % 10 AS conv_id, conv_id * 100 + turn AS seq, conv_id || ':' || turn AS message_id, role, text AS content FROM conversations),
convs AS MATERIALIZED (SELECT conv_id, 'p' || conv_id % 3 AS project_id, CASE WHEN conv_id % 3 <> 1 THEN 'about ' || conv_id END AS summary,
    CASE conv_id % 3 WHEN 0 THEN conv_id || ':1' WHEN 1 THEN conv_id || ':0' ELSE 'unknown' END AS summary_through_id,
    CASE conv_id % 4 WHEN 0 THEN 'New Chat' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE 'Kept' END AS title, max(seq) AS updated_at
  FROM messages GROUP BY conv_id),
cut AS MATERIALIZED (SELECT m.conv_id, m.seq AS cut, c.summary FROM messages m JOIN convs c ON c.conv_id = m.conv_id AND c.summary_through_id = m.message_id),
live AS MATERIALIZED (SELECT m.* FROM messages m LEFT JOIN cut c ON c.conv_id = m.conv_id AND c.summary IS NOT NULL WHERE c.cut IS NULL OR m.seq > c.cut),
last_ AS MATERIALIZED (SELECT conv_id, arg_max(content, seq) AS content, arg_max(role, seq) AS role, max(seq) AS seq FROM messages GROUP BY conv_id),
asked AS MATERIALIZED (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '  ' || content || chr(10) ELSE 'else' END AS question, conv_id % 4 = 1 AS regenerate FROM last_)
"""


def _messages(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") % 10).alias("conv_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        "role", F.col("text").alias("content"))


def _conversations(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    name = c.cast("string")
    return _messages(t).groupBy("conv_id").agg(F.max("seq").alias("updated_at")).select(
        "conv_id", F.concat(F.lit("p"), (c % 3).cast("string")).alias("project_id"),
        F.when(c % 3 != 1, F.concat(F.lit("about "), name)).alias("summary"),
        F.when(c % 3 == 0, F.concat(name, F.lit(":1"))).when(c % 3 == 1, F.concat(name, F.lit(":0")))
        .otherwise("unknown").alias("summary_through_id"),
        F.when(c % 4 == 0, "New Chat").when(c % 4 == 2, "  ").when(c % 4 == 3, "Kept").alias("title"), "updated_at")


def _asked(t: Tables) -> DataFrame:
    last = _messages(t).groupBy("conv_id").agg(F.max_by("content", "seq").alias("content"))
    c = F.col("conv_id")
    return last.select("conv_id", F.when(c % 2 == 0, F.concat(F.lit("  "), "content", F.lit("\n"))).otherwise("else")
                       .alias("question"), (c % 4 == 1).alias("regenerate"))


@query("live_history", f"WITH {MESSAGES_SQL} SELECT conv_id, seq, role FROM live")
def live_history(t: Tables) -> DataFrame:
    """WIN-3."""
    return CV.live_history(_messages(t), _conversations(t)).select("conv_id", "seq", "role")


@query("history_window", f"""WITH {MESSAGES_SQL},
b AS (SELECT l.*, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.seq DESC) AS back, a.regenerate, trim(a.question, ' ' || chr(10)) AS q FROM live l JOIN asked a USING (conv_id)),
d1 AS (SELECT conv_id, max(CASE WHEN regenerate AND back = 1 AND role = 'assistant' THEN 1 ELSE 0 END) AS d FROM b GROUP BY 1),
d2 AS (SELECT b.conv_id, max(d) + max(CASE WHEN back = d + 1 AND role = 'user' AND content = q THEN 1 ELSE 0 END) AS d FROM b JOIN d1 USING (conv_id) GROUP BY 1)
SELECT b.conv_id, seq, role, substr(content, 1, 2000) AS content FROM b JOIN d2 USING (conv_id) WHERE back > d AND back <= d + 8
UNION ALL SELECT c.conv_id, -1, 'system', 'Earlier discussion summary: ' || summary FROM convs c JOIN asked a USING (conv_id)
  WHERE summary IS NOT NULL AND NOT a.regenerate""")
def history_window(t: Tables) -> DataFrame:
    """WIN-4."""
    conversations = _conversations(t)
    return CV.history_window(CV.live_history(_messages(t), conversations), _asked(t), conversations)


@query("summarise_trigger", f"""WITH {MESSAGES_SQL},
n AS (SELECT m.conv_id, count(*) AS n, sum(length(content))::BIGINT AS total, count(*) FILTER (m.seq > c.cut) AS after, max(c.cut) AS cut
      FROM messages m LEFT JOIN cut c USING (conv_id) GROUP BY 1),
o AS (SELECT conv_id, greatest(n - 8, 0) - CASE WHEN cut IS NOT NULL AND after >= 8 THEN 1 ELSE 0 END AS old, total FROM n)
SELECT conv_id, old AS old_messages, total AS total_chars, old > 6 OR total > 42000 AS summarise FROM o""")
def summarise_trigger(t: Tables) -> DataFrame:
    """WIN-5."""
    return CV.summarise_trigger(_messages(t), _conversations(t))


@query("summarise_uncovered", f"""WITH {MESSAGES_SQL},
n AS (SELECT m.conv_id, count(*) AS n, sum(length(content))::BIGINT AS total, count(*) FILTER (m.seq > c.cut) AS after, max(c.cut) AS cut
      FROM messages m LEFT JOIN cut c ON c.conv_id = m.conv_id AND c.summary IS NOT NULL GROUP BY 1),
o AS (SELECT conv_id, CASE WHEN cut IS NULL THEN greatest(n - 8, 0) ELSE greatest(after - 8, 0) END AS old, total FROM n)
SELECT conv_id, old AS old_messages, total AS total_chars, old > 6 OR total > 42000 AS summarise FROM o""")
def summarise_uncovered(t: Tables) -> DataFrame:
    """WIN-5, counting only what the summary does not cover."""
    return CV.summarise_trigger(_messages(t), _conversations(t), mode="uncovered")


@query("regenerate_upsert", f"""WITH {MESSAGES_SQL},
a AS (SELECT conv_id, 'new:' || conv_id AS message_id, 'fresh answer' AS content, conv_id % 2 = 0 AS regenerate FROM last_),
p AS (SELECT a.*, l.seq, a.regenerate AND l.role = 'assistant' AS swap FROM a JOIN last_ l USING (conv_id))
SELECT m.conv_id, m.seq, m.message_id, m.role, CASE WHEN p.swap AND p.seq = m.seq THEN p.content ELSE m.content END AS content FROM messages m JOIN p USING (conv_id)
UNION ALL SELECT conv_id, seq + 1, message_id, 'assistant', content FROM p WHERE NOT swap""")
def regenerate_upsert(t: Tables) -> DataFrame:
    """WIN-6."""
    messages = _messages(t)
    answers = messages.select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("new:"), F.col("conv_id").cast("string")).alias("message_id"),
        F.lit("fresh answer").alias("content"), (F.col("conv_id") % 2 == 0).alias("regenerate"))
    return CV.regenerate_upsert(messages, answers)


@query("conversation_titles", f"""WITH {MESSAGES_SQL},
f AS (SELECT conv_id, arg_min(content, seq) AS q FROM messages WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN q IS NULL OR title = 'Kept' THEN title ELSE substr(trim(string_split(trim(q, ' ' || chr(10)), chr(10))[1]), 1, 40) END AS title
FROM convs LEFT JOIN f USING (conv_id)""")
def conversation_titles(t: Tables) -> DataFrame:
    """FN-11."""
    return CV.titled(_conversations(t), _messages(t)).select("conv_id", "title")


STUB = CV.TOOL_RESULT_STUB


@query("budget_trim", f"""WITH {MESSAGES_SQL},
m AS (SELECT conv_id AS run_id, seq, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS role, content FROM messages),
s AS (SELECT *, CASE WHEN role = 'tool' THEN length(content) - {len(STUB)} ELSE 0 END AS saving, sum(length(content)) OVER (PARTITION BY run_id) AS total FROM m),
p AS (SELECT *, sum(saving) OVER (PARTITION BY run_id ORDER BY seq) AS upto FROM s),
q AS (SELECT *, greatest(0, coalesce(max(upto) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS peak FROM p)
SELECT run_id, seq, role, role = 'tool' AND total > 6000 AND peak < total - 6000 AS stubbed FROM q""")
def budget_trim(t: Tables) -> DataFrame:
    """WIN-7 with a budget that this data exceeds."""
    messages = _messages(t).select(
        F.col("conv_id").alias("run_id"), "seq",
        F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), "content")
    return CV.trim_to_budget(messages, budget=6000).select("run_id", "seq", "role", "stubbed")


@query("prompt_chars", f"""WITH {MESSAGES_SQL}
SELECT conv_id, (max(length(a.question)) + sum(length(m.content)) + 3)::BIGINT AS used_chars FROM messages m JOIN asked a USING (conv_id) GROUP BY conv_id""")
def prompt_chars(t: Tables) -> DataFrame:
    """FN-17 as a sum over exploded parts (no array of a whole conversation)."""
    history = _messages(t).groupBy("conv_id").agg(F.sum(F.length("content")).alias("history_chars"))
    sized = _asked(t).join(history, "conv_id")
    fixed = CV.prompt_chars(F.col("question"), F.array().cast("array<string>"), F.array(F.lit("abc"), F.lit(None)))
    return sized.select("conv_id", (fixed + F.col("history_chars")).alias("used_chars"))


@query("ordered_messages", f"WITH {MESSAGES_SQL} SELECT conv_id, seq, message_id FROM messages")
def ordered_messages(t: Tables) -> DataFrame:
    """WIN-8."""
    return CV.ordered_messages(_messages(t)).select("conv_id", "seq", "message_id")


@query("resolve_conversation", f"""WITH {MESSAGES_SQL},
r AS (SELECT item_id AS request_id, 'p' || item_id % 4 AS project_id, CASE WHEN item_id % 2 = 0 THEN item_id % 12 END AS conv_id FROM benchmark),
n AS (SELECT project_id, arg_max(conv_id, updated_at * 100 + conv_id) AS newest FROM convs GROUP BY 1)
SELECT request_id, CASE WHEN r.conv_id IS NOT NULL THEN c.conv_id::VARCHAR WHEN n.newest IS NOT NULL THEN n.newest::VARCHAR
    ELSE sha256('conversation:' || r.project_id || ':' || request_id) END AS resolved_id,
  CASE WHEN r.conv_id IS NOT NULL THEN CASE WHEN c.conv_id IS NOT NULL THEN 'given' ELSE 'not_found' END WHEN n.newest IS NOT NULL THEN 'newest' ELSE 'new' END AS how
FROM r LEFT JOIN convs c ON c.conv_id = r.conv_id AND c.project_id = r.project_id LEFT JOIN n ON n.project_id = r.project_id""")
def resolve_conversation(t: Tables) -> DataFrame:
    """WIN-2."""
    i = F.col("item_id")
    requests = t.benchmark.select(i.alias("request_id"), F.concat(F.lit("p"), (i % 4).cast("string")).alias("project_id"),
                                  F.when(i % 2 == 0, i % 12).alias("conv_id"))
    return CV.resolve_conversation(requests, _conversations(t)).select("request_id", "resolved_id", "how")


@query("conversation_backfill", """WITH m AS (SELECT conv_id * 100 + turn AS message_id, conv_id % 40 AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id END AS conversation_id FROM conversations)
SELECT message_id, session_id, coalesce(conversation_id, CASE WHEN session_id < 30 THEN sha256('earlier:p' || session_id % 5) END) AS conversation_id FROM m""")
def conversation_backfill(t: Tables) -> DataFrame:
    """WIN-12."""
    c = F.col("conv_id")
    messages = t.conversations.select(
        (c * 100 + F.col("turn")).alias("message_id"), (c % 40).alias("session_id"),
        F.when(c % 2 == 0, F.concat(F.lit("c"), c.cast("string"))).alias("conversation_id"))
    sessions = messages.select("session_id").distinct().filter("session_id < 30").select(
        "session_id", F.concat(F.lit("p"), (F.col("session_id") % 5).cast("string")).alias("project_id"))
    return CV.backfill_conversations(messages, sessions)[1].select("message_id", "session_id", "conversation_id")


@query("json_fields", """SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, '' AS missing,
  CASE event_id % 3 WHEN 0 THEN 'plain ' || event_type WHEN 1 THEN event_type ELSE '' END AS answer FROM events""")
def json_fields(t: Tables) -> DataFrame:
    """FN-18."""
    e = F.col("event_id") % 3
    payload = F.when(e == 0, F.concat(F.lit("  plain "), "event_type", F.lit("\n"))) \
        .when(e == 1, F.to_json(F.struct(F.col("event_type").alias("answer")))).otherwise("{broken")
    return t.events.select("event_id", TX.json_text("props", "k").alias("k"), TX.json_text("props", "z").alias("missing"),
                           TX.answer_text(payload).alias("answer"))


@query("relative_time", f"""WITH d AS (SELECT event_id, ts, floor(epoch_us(TIMESTAMP '{NOW}' - ts + INTERVAL 0 SECOND) / 60000000.0)::BIGINT AS m FROM (
    SELECT event_id, ts FROM events))
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || ' hr ago'
  WHEN m < 10080 THEN (m // 1440) || ' day ago' WHEN m < 43200 THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%b %Y') END AS label FROM d""")
def relative_time(t: Tables) -> DataFrame:
    """FN-12."""
    return t.events.select("event_id", TX.relative_time("ts", _now()).alias("label"))


# ---- jobs -----------------------------------------------------------------------

STATUS = ["queued", "processing", "ready", "error", "cancelled"]
JOBS_SQL = f"""
jobs AS MATERIALIZED (SELECT event_id AS job_id, 'p' || user_id AS project_id, {STATUS}[event_id % 5 + 1] AS status, md5((value::INT % 20)::VARCHAR) AS content_hash,
  ts AS created_at, ts + to_seconds(event_id % 900) AS locked_at, ts + to_minutes((event_id % 50)::INT) AS next_run_at, (event_id % 4)::INT AS attempts, 3 AS max_attempts,
  ts AS updated_at FROM events)
"""


def _jobs(t: Tables) -> DataFrame:
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS]), (e % 5 + 1).cast("int"))
    return t.events.select(
        e.alias("job_id"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("project_id"),
        status.alias("status"), F.md5((F.rint("value").cast("int") % 20).cast("string")).alias("content_hash"),
        F.col("ts").alias("created_at"), (F.col("ts") + J.seconds(e % 900)).alias("locked_at"),
        (F.col("ts") + J.seconds((e % 50) * 60)).alias("next_run_at"), (e % 4).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"), F.col("ts").alias("updated_at"))


@query("latest_jobs", f"""WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) AS n FROM jobs)
SELECT project_id, job_id, status, created_at FROM r WHERE n = 1""")
def latest_jobs(t: Tables) -> DataFrame:
    """WIN-1."""
    return J.latest_jobs(_jobs(t)).select("project_id", "job_id", "status", "created_at")


@query("latest_orders", """SELECT o_custkey AS project_id, max(o_orderkey) FILTER (o_orderdate = latest) AS job_id, max(latest) AS created_at
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS latest FROM orders) GROUP BY 1""")
def latest_orders(t: Tables) -> DataFrame:
    """WIN-1 and SQL-6 on orders."""
    jobs = t.orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("job_id"),
                           F.col("o_orderdate").alias("created_at"))
    return J.latest_jobs(jobs).select("project_id", "job_id", "created_at")


@query("attention_sort", f"""WITH {JOBS_SQL}
SELECT job_id, CASE WHEN status IN ('pending', 'processing', 'error') THEN 0 ELSE 1 END AS attention, updated_at AS touched_at FROM jobs""")
def attention_sort(t: Tables) -> DataFrame:
    """WIN-9."""
    return J.attention_first(_jobs(t)).select("job_id", *J.attention_columns())


@query("idempotent_lookup", f"""WITH {JOBS_SQL},
u AS (SELECT o_orderkey AS upload_id, 'p' || o_custkey % 150 AS project_id, md5((o_totalprice::INT % 20)::VARCHAR) AS content_hash FROM orders),
a AS (SELECT project_id, content_hash, arg_max(job_id, (epoch_us(created_at), job_id)) AS existing FROM jobs WHERE status IN ('queued', 'processing', 'ready') GROUP BY ALL),
f AS (SELECT project_id, content_hash, min(upload_id) AS first_ FROM u GROUP BY ALL)
SELECT upload_id, coalesce(existing::VARCHAR, sha256(u.project_id || ':' || u.content_hash || ':' || first_)) AS job_id,
  existing IS NOT NULL OR upload_id <> first_ AS reused
FROM u JOIN f USING (project_id, content_hash) LEFT JOIN a USING (project_id, content_hash)""")
def idempotent_lookup(t: Tables) -> DataFrame:
    """WIN-10: every order is an upload."""
    uploads = t.orders.select(
        F.col("o_orderkey").alias("upload_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 150).cast("string")).alias("project_id"),
        F.md5((F.rint("o_totalprice").cast("int") % 20).cast("string")).alias("content_hash"))
    return J.match_uploads(uploads, _jobs(t)).select("upload_id", "job_id", "reused")


@query("claimable_jobs", f"""WITH {JOBS_SQL} SELECT job_id, status, next_run_at FROM jobs
WHERE (status = 'queued' AND next_run_at <= TIMESTAMP '{NOW}') OR (status = 'processing' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND)""")
def claimable_jobs(t: Tables) -> DataFrame:
    """WIN-11, SQL-9."""
    return J.claimable(_jobs(t), _now()).select("job_id", "status", "next_run_at")


@query("stale_requeue", f"""WITH {JOBS_SQL}, s AS (SELECT *, status = 'processing' AND locked_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND AS stale FROM jobs)
SELECT job_id, CASE WHEN stale THEN 'queued' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{NOW}' ELSE next_run_at END AS next_run_at,
  CASE WHEN NOT stale THEN locked_at END AS locked_at, attempts FROM s""")
def stale_requeue(t: Tables) -> DataFrame:
    """STR-4."""
    return J.requeue_stale(_jobs(t), _now()).select("job_id", "status", "next_run_at", "locked_at", "attempts")


@query("conditional_finish", f"""WITH {JOBS_SQL}, s AS (SELECT *, job_id % 3 = 0 AND status = 'processing' AS done FROM jobs)
SELECT job_id, CASE WHEN done THEN 'ready' ELSE status END AS status, CASE WHEN done THEN 100 ELSE 10 END AS progress_percent FROM s""")
def conditional_finish(t: Tables) -> DataFrame:
    """STR-2, SQL-8: ready only from processing."""
    jobs = _jobs(t).withColumn("progress_percent", F.lit(10))
    done = jobs.filter("job_id % 3 = 0").select("job_id")
    return J.complete_if_processing(jobs, done, _now()).select("job_id", "status", "progress_percent")


@query("retry_backoff", f"""WITH {JOBS_SQL}
SELECT job_id, CASE WHEN status <> 'cancelled' AND attempts < 3 THEN 'queued' WHEN status = 'processing' THEN 'error' ELSE status END AS status,
  CASE WHEN status <> 'cancelled' AND attempts < 3 THEN TIMESTAMP '{NOW}' + to_seconds((2 ** attempts * 30)::INT) ELSE next_run_at END AS next_run_at,
  status = 'processing' AND attempts >= 3 AS purge FROM jobs""")
def retry_backoff(t: Tables) -> DataFrame:
    """STR-3."""
    return J.after_failure(_jobs(t), _now()).select("job_id", "status", "next_run_at", "purge")


@query("progress_latest", """SELECT user_id AS job_id, (45 + floor(arg_max(regexp_extract(props, '[0-9]+')::INT, (epoch_us(ts), event_id)) * 0.35::DOUBLE + 0.5))::INT AS progress_percent,
  max(ts) AS locked_at FROM events GROUP BY 1""")
def progress_latest(t: Tables) -> DataFrame:
    """STR-5."""
    events = t.events.select(F.col("user_id").alias("job_id"), "event_id", "ts",
                             TX.json_text("props", "k").cast("int").alias("percent"))
    return J.latest_progress(events)


@query("cancel_guard", f"""WITH {JOBS_SQL}, l AS (SELECT project_id, arg_max(job_id, (epoch_us(created_at), job_id)) AS latest FROM jobs GROUP BY 1),
p AS (SELECT DISTINCT project_id, CASE WHEN (substr(project_id, 2))::INT % 3 = 0 THEN 'ready' ELSE 'processing' END AS status FROM jobs)
SELECT j.project_id, j.job_id, p.status <> 'ready' AND l.latest = j.job_id AS apply FROM jobs j JOIN p USING (project_id) JOIN l USING (project_id) WHERE j.status = 'cancelled'""")
def cancel_guard(t: Tables) -> DataFrame:
    """STR-7."""
    jobs = _jobs(t)
    odd = F.substring("project_id", 2, 20).cast("int") % 3 == 0
    projects = jobs.select("project_id").distinct().select("project_id", F.when(odd, "ready").otherwise("processing").alias("status"))
    return J.cancel_guard(jobs.filter("status = 'cancelled'").select("project_id", "job_id"), jobs, projects)


FOLD_SQL = """
ev AS MATERIALIZED (SELECT user_id AS job_id, event_id, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_id % 41 = 0 THEN 'cancel' WHEN event_id % 7 = 0 THEN 'requeue'
    ELSE CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'heartbeat' ELSE CASE WHEN event_id % 5 = 0 THEN 'complete' ELSE 'fail' END END END AS event,
    regexp_extract(props, '[0-9]+')::INT AS percent, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
fold AS (
  WITH RECURSIVE f AS (
    SELECT job_id, 0::BIGINT AS n, 'none' AS status, 0 AS attempts, 0 AS progress, NULL::BIGINT AS next_run, NULL::BIGINT AS locked FROM (SELECT DISTINCT job_id FROM ev)
    UNION ALL
    SELECT f.job_id, e.n,
      CASE WHEN enqueue OR retry OR requeue THEN 'queued' WHEN claim THEN 'processing' WHEN complete THEN 'ready' WHEN err THEN 'error' WHEN cancel THEN 'cancelled' ELSE f.status END,
      f.attempts + CASE WHEN claim THEN 1 ELSE 0 END,
      CASE WHEN complete THEN 100 WHEN beat THEN e.percent ELSE f.progress END,
      CASE WHEN enqueue OR requeue THEN e.ms WHEN retry THEN e.ms + 30000 * (2 ** f.attempts)::BIGINT ELSE f.next_run END,
      CASE WHEN complete OR cancel OR retry OR err OR requeue THEN NULL WHEN claim OR beat THEN e.ms ELSE f.locked END
    FROM f JOIN ev e ON e.job_id = f.job_id AND e.n = f.n + 1,
    LATERAL (SELECT coalesce(f.status = 'processing' AND f.locked < e.ms - 300000, false) AS stale) s,
    LATERAL (SELECT e.event = 'enqueue' AND f.status = 'none' AS enqueue,
      e.event = 'claim' AND (stale OR coalesce(f.status = 'queued' AND f.next_run <= e.ms, false)) AS claim,
      e.event = 'heartbeat' AND f.status = 'processing' AS beat, e.event = 'complete' AND f.status = 'processing' AS complete,
      e.event = 'cancel' AND f.status IN ('queued', 'processing') AS cancel,
      e.event = 'fail' AND f.status NOT IN ('none', 'cancelled') AND f.attempts < 3 AS retry,
      e.event = 'fail' AND f.status = 'processing' AND f.attempts >= 3 AS err, e.event = 'requeue' AND stale AS requeue) k)
  SELECT * FROM f)
"""


def _job_events(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 41 == 0, "cancel").when(e % 7 == 0, "requeue").when(F.col("event_type") == "signup", "enqueue") \
        .when(F.col("event_type") == "click", "claim").when(F.col("event_type").isin("view", "purchase"), "heartbeat") \
        .when(e % 5 == 0, "complete").otherwise("fail")
    return t.events.select(F.col("user_id").alias("job_id"), "event_id", "ts", kind.alias("event"),
                           TX.json_text("props", "k").cast("int").alias("percent"))


FOLD_RESULT_SQL = f"""WITH {FOLD_SQL}, last_ AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS r FROM fold)
SELECT job_id, status, attempts, progress AS progress_percent, next_run AS next_run_ms, locked AS locked_ms FROM last_ WHERE r = 1"""


def _fold_view(state: DataFrame) -> DataFrame:
    return state.select("job_id", "status", "attempts", "progress_percent",
                        F.unix_millis("next_run_at").alias("next_run_ms"), F.unix_millis("locked_at").alias("locked_ms"))


@query("job_state_fold", FOLD_RESULT_SQL)
def job_state_fold(t: Tables) -> DataFrame:
    """STR-2: lifecycle of every job from its events."""
    return _fold_view(job_states(_job_events(t)))


@query("job_state_rounds", FOLD_RESULT_SQL)
def job_state_rounds(t: Tables) -> DataFrame:
    """STR-2 with the log in many partitions, so that jobs are cut and their maps chained."""
    return _fold_view(job_states(_job_events(t), partitions=97))


# ---- request limits ---------------------------------------------------------------

LIMIT_SQL = """
req AS MATERIALIZED (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'CHAT' WHEN 'purchase' THEN 'AGENT' WHEN 'view' THEN 'SEARCH' WHEN 'signup' THEN 'AUTH' END AS bucket,
  (epoch_us(ts) // 1000) AS ms FROM events)
"""


def _requests(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    uri = F.when(kind == "click", "/api/projects/p1/conversations/c9/messages/stream").when(kind == "purchase", "/api/projects/p1/agent/run") \
        .when(kind == "view", "/api/projects/p1/search").when(kind == "signup", "/api/auth/register") \
        .otherwise("/api/projects/p1/conversations/c9/messages")
    method = F.when(kind == "error", "GET").otherwise("POST")
    return t.events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("caller"),
                           TX.route_bucket(method, uri).alias("bucket"), "ts")


@query("route_buckets", f"WITH {LIMIT_SQL} SELECT event_id AS request_id, bucket FROM req")
def route_buckets(t: Tables) -> DataFrame:
    """FN-15."""
    return _requests(t).select("request_id", "bucket")


@query("rate_limit", f"""WITH {LIMIT_SQL},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ms, event_id) AS n FROM req WHERE bucket IS NOT NULL),
w AS (
  WITH RECURSIVE r AS (
    SELECT user_id, bucket, n, event_id, ms, ms AS start, 1::BIGINT AS used FROM o WHERE n = 1
    UNION ALL
    SELECT o.user_id, o.bucket, o.n, o.event_id, o.ms, CASE WHEN o.ms - r.start >= 86400000 THEN o.ms ELSE r.start END, CASE WHEN o.ms - r.start >= 86400000 THEN 1 ELSE r.used + 1 END
    FROM r JOIN o ON o.user_id = r.user_id AND o.bucket = r.bucket AND o.n = r.n + 1)
  SELECT * FROM r)
SELECT event_id AS request_id, start AS window_start_ms, used AS request_no, used <= 1 AS allowed,
  CASE WHEN used > 1 THEN greatest(1, (86400000 - (ms - start) + 999) // 1000) END AS retry_after_s FROM w""")
def rate_limit(t: Tables) -> DataFrame:
    """STR-1 with a window of one day and one request, which this log exceeds."""
    limits = {"AUTH": 1, "CHAT": 1, "AGENT": 1, "SEARCH": 1}
    return RL.rate_limit(_requests(t), limits, window_ms=86_400_000).select(
        "request_id", "window_start_ms", "request_no", "allowed", "retry_after_s")


# ---- run reports ------------------------------------------------------------------

RUNS_SQL = """
runs AS MATERIALIZED (SELECT *, CASE WHEN model = 'openai/gpt-oss-20b' THEN input_tokens / 1000000.0::DOUBLE * 0.075::DOUBLE + output_tokens / 1000000.0::DOUBLE * 0.3::DOUBLE
    WHEN model = 'llama-3.3-70b-versatile' THEN input_tokens / 1000000.0::DOUBLE * 0.59::DOUBLE + output_tokens / 1000000.0::DOUBLE * 0.79::DOUBLE ELSE 0 END AS cost_usd
  FROM (SELECT event_id AS run_id, value AS latency_s, k % 9 AS tool_calls, k % 4 AS iterations, (k % 5) / 4.0::DOUBLE AS citation_accuracy, (k % 3) / 2.0::DOUBLE AS points_ratio,
    CASE WHEN event_type = 'error' THEN 'failed' END AS error, CASE WHEN k % 17 = 0 THEN 'judge' END AS judge_error, k * 100 AS input_tokens, k * 7 AS output_tokens,
    CASE k % 3 WHEN 0 THEN 'openai/gpt-oss-20b' WHEN 1 THEN 'llama-3.3-70b-versatile' ELSE 'other' END AS model
    FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)))
"""

#: fixed values: price table, USD per million tokens
PRICES = (("openai/gpt-oss-20b", 0.075, 0.3), ("llama-3.3-70b-versatile", 0.59, 0.79))


def _runs(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.events.withColumn("k", TX.json_text("props", "k").cast("long")).select(
        F.col("event_id").alias("run_id"), F.col("value").alias("latency_s"), (k % 9).alias("tool_calls"),
        (k % 4).alias("iterations"), ((k % 5) / 4.0).alias("citation_accuracy"), ((k % 3) / 2.0).alias("points_ratio"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(k % 17 == 0, "judge").alias("judge_error"),
        (k * 100).alias("input_tokens"), (k * 7).alias("output_tokens"),
        F.when(k % 3 == 0, PRICES[0][0]).when(k % 3 == 1, PRICES[1][0]).otherwise("other").alias("model"))
    prices = t.spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    # a two-row price table
    return rows.join(F.broadcast(prices), "model", "left").withColumn(
        "cost_usd", TX.cost_usd("input_tokens", "output_tokens", "input_price", "output_price"))


@query("run_cost", f"WITH {RUNS_SQL} SELECT run_id, round(cost_usd, 8) AS cost_usd FROM runs")
def run_cost(t: Tables) -> DataFrame:
    """FN-14."""
    return _runs(t).select("run_id", F.round("cost_usd", 8).alias("cost_usd"))


@query("run_aggregates", f"""WITH {RUNS_SQL}, ok AS (SELECT * FROM runs WHERE error IS NULL)
SELECT round(avg(citation_accuracy), 6) AS citation_accuracy, round(avg(points_ratio), 6) AS answer_accuracy, round(avg((points_ratio = 1)::INT), 6) AS all_points_pass_rate,
  round(avg(latency_s), 6) AS avg_latency_s, round(avg(tool_calls), 6) AS avg_tool_calls, round(avg(iterations), 6) AS avg_iterations, round(avg(cost_usd), 8) AS avg_cost_usd,
  round(sum(cost_usd), 6) AS total_cost_usd, sum(input_tokens)::BIGINT AS input_tokens_total, sum(output_tokens)::BIGINT AS output_tokens_total,
  (SELECT count(*) FROM runs) AS total_runs, (SELECT count(*) FROM runs WHERE error IS NOT NULL) AS failed_runs, (SELECT count(judge_error) FROM runs) AS judge_errors,
  quantile_disc(latency_s, 0.95) AS p95_latency_s FROM ok""")
def run_aggregates(t: Tables) -> DataFrame:
    """AGG-9, AGG-10."""
    rounded = {"avg_cost_usd": 8}
    row = E.run_aggregates(_runs(t))
    doubles = [f.name for f in row.schema.fields if f.dataType.typeName() == "double" and f.name != "p95_latency_s"]
    return row.select(*[F.round(c, rounded.get(c, 6)).alias(c) if c in doubles else F.col(c) for c in row.columns])


@query("p95_latency", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def p95_latency(t: Tables) -> DataFrame:
    """AGG-10 per group."""
    return E.nearest_ranks(t.events, "value", 0.95, ["event_type"]).withColumnRenamed("value", "p95")


@query("run_failures", f"WITH {RUNS_SQL} SELECT run_id FROM runs WHERE error IS NOT NULL OR judge_error IS NOT NULL OR citation_accuracy < 1 OR points_ratio < 1")
def run_failures(t: Tables) -> DataFrame:
    """AGG-11."""
    return E.run_failures(_runs(t)).select("run_id")


@query("verdict_ratio", """WITH v AS (SELECT event_id, (event_id % 4)::INT AS n, (event_id % 3)::INT + 1 AS points, list_transform(range(0, event_id % 4), lambda i: (event_id + i) % 2 = 0) AS verdicts FROM events)
SELECT event_id, CASE WHEN n <> points THEN 0 ELSE len(list_filter(verdicts, lambda x: x)) END::INT AS points_passed, points AS points_total,
  CASE WHEN n <> points THEN 0.0 ELSE len(list_filter(verdicts, lambda x: x)) / points END::DOUBLE AS points_ratio, n <> points AS length_mismatch FROM v""")
def verdict_ratio(t: Tables) -> DataFrame:
    """AGG-8."""
    e = F.col("event_id")
    n = (e % 4).cast("int")
    verdicts = F.when(n == 0, F.array().cast("array<boolean>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (e + i) % 2 == 0))
    points = F.transform(F.sequence(F.lit(1), (e % 3).cast("int") + 1), lambda i: F.lit("point"))
    rows = t.events.select("event_id", verdicts.alias("verdicts"), points.alias("reference_points"))
    return rows.select("event_id", *E.verdict_ratio())


@query("token_usage", """WITH c AS (SELECT user_id AS run_id, k, CASE WHEN user_id % 2 = 0 THEN 0 ELSE k * 3 END AS total FROM (SELECT user_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events))
SELECT run_id, sum(k)::BIGINT AS input_tokens, sum(k * 2)::BIGINT AS output_tokens, CASE WHEN sum(total) = 0 THEN sum(k * 3) ELSE sum(total) END::BIGINT AS total_tokens FROM c GROUP BY 1""")
def token_usage(t: Tables) -> DataFrame:
    """AGG-15."""
    k = TX.json_text("props", "k").cast("long")
    calls = t.events.select(F.col("user_id").alias("run_id"), k.alias("input_tokens"), (k * 2).alias("output_tokens"),
                            F.when(F.col("user_id") % 2 == 0, F.lit(0).cast("long")).otherwise(k * 3).alias("total_tokens"))
    return E.token_usage(calls)


@query("repeat_calls", """WITH c AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 's:q' || k % 20 WHEN 'view' THEN 'f:f' || k % 20 WHEN 'purchase' THEN 's:grep:p' || k % 10 || ':' || 'src' END AS key
  FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events))
SELECT run_id, seq, key IS NOT NULL AND row_number() OVER (PARTITION BY run_id, key ORDER BY seq) > 1 AS is_repeat FROM c""")
def repeat_calls(t: Tables) -> DataFrame:
    """AGG-16."""
    k = TX.json_text("props", "k").cast("long")
    kind = F.col("event_type")
    calls = t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
        F.when(kind == "click", "search_code").when(kind == "view", "read_file").when(kind == "purchase", "grep")
        .otherwise("list_files").alias("tool"),
        F.concat(F.lit("q"), (k % 20).cast("string")).alias("query"), F.concat(F.lit("p"), (k % 10).cast("string")).alias("pattern"),
        F.when(kind == "purchase", "src").otherwise(F.concat(F.lit("f"), (k % 20).cast("string"))).alias("file_path"))
    return E.mark_repeats(calls).select("run_id", "seq", "is_repeat")


QUESTION_SQL = """
q AS MATERIALIZED (SELECT 'q' || item_id AS id, 'src' || item_id % 25 AS repo, CASE WHEN item_id % 11 = 0 THEN NULL ELSE text END AS question,
  ['locate', 'explain', 'trace-call-flow', 'other'][item_id % 4 + 1] AS type, ['src' || item_id % 25 || '/en/doc_' || item_id || '.txt'] AS files,
  CASE WHEN item_id % 7 = 0 THEN [5, 2] ELSE [1, item_id % 60] END AS r, (item_id % 5)::INT AS points FROM benchmark),
f AS MATERIALIZED (SELECT source AS repo, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, __LINES__ AS n FROM documents),
known AS MATERIALIZED (SELECT q.* FROM q WHERE repo IN (SELECT source FROM documents))
"""


def _question_sql() -> str:
    from corpuscope.plans.corpus import N_LINES

    return QUESTION_SQL.replace("__LINES__", N_LINES)


@query("question_validation", f"""WITH {_question_sql()}
SELECT id AS question_id, 'missing required field question' AS problem FROM q WHERE question IS NULL
UNION ALL SELECT id, 'unknown repo ' || repo FROM q WHERE repo NOT IN (SELECT source FROM documents)
UNION ALL SELECT id, 'bad type ' || type FROM known WHERE type = 'other'
UNION ALL SELECT id, 'needs 2-3 answer points, got ' || points FROM known WHERE points NOT BETWEEN 2 AND 3
UNION ALL SELECT id, files[1] || ' missing' FROM known k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo = k.repo AND f.path = k.files[1])
UNION ALL SELECT id, 'malformed line range [' || r[1] || ', ' || r[2] || ']' FROM known WHERE r[1] > r[2]
UNION ALL SELECT id, 'range [' || r[1] || ', ' || r[2] || '] exceeds ' || f.path || ' (' || n || ' lines)' FROM known k JOIN f ON f.repo = k.repo AND f.path = k.files[1]
  WHERE r[1] <= r[2] AND r[2] > n""")
def question_validation(t: Tables) -> DataFrame:
    """AGG-12."""
    from corpuscope.operators.lines import line_counts
    from corpuscope.plans.derived import text_files

    i = F.col("item_id")
    repo = F.concat(F.lit("src"), (i % 25).cast("string"))
    kinds = F.array(*[F.lit(x) for x in ("locate", "explain", "trace-call-flow", "other")])
    questions = t.benchmark.select(
        F.concat(F.lit("q"), i.cast("string")).alias("id"), repo.alias("repo"),
        F.when(i % 11 != 0, F.col("text")).alias("question"), F.element_at(kinds, (i % 4 + 1).cast("int")).alias("type"),
        F.array(F.concat(repo, F.lit("/en/doc_"), i.cast("string"), F.lit(".txt"))).alias("expected_files"),
        F.array(F.when(i % 7 == 0, F.array(F.lit(5), F.lit(2))).otherwise(F.array(F.lit(1), (i % 60).cast("int"))))
        .alias("expected_line_ranges"),
        F.array_repeat(F.lit("point"), (i % 5).cast("int")).alias("reference_answer_points"))
    files = line_counts(text_files(t.documents)).select(F.col("project_id").alias("repo"), "path", "n_lines")
    return E.question_problems(questions, t.documents.select(F.col("source").alias("repo")), files)


# ---- SQL primitives on the star tables --------------------------------------------

@query("call_edge_join", """WITH s AS (SELECT p_partkey % 50 AS project_id, lower(p_name) AS k, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT l_partkey % 50 AS project_id, lower(p_name) AS k, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT r.project_id, r.k AS name_key, count(*) AS calls, sum(n)::BIGINT AS candidates FROM r JOIN s USING (project_id, k) GROUP BY ALL""")
def call_edge_join(t: Tables) -> DataFrame:
    """GRF-11, SQL-1, SQL-5 at fact-table scale: counts per name, then the join."""
    from corpuscope.operators.graph import name_key, symbol_counts

    parts = t.part.select((F.col("p_partkey") % 50).alias("project_id"), F.col("p_name").alias("name"), "p_partkey")
    names = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("project_id", name_key("name").alias("name_key"))
    calls = names.groupBy("project_id", "name_key").agg(F.count("*").alias("calls"))
    return calls.join(symbol_counts(parts), ["project_id", "name_key"]).select(
        "project_id", "name_key", "calls", (F.col("calls") * F.col("candidates")).alias("candidates"))


@query("semi_distinct", """SELECT DISTINCT l_suppkey AS suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F')""")
def semi_distinct(t: Tables) -> DataFrame:
    """SQL-2, SQL-4."""
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(done, "l_orderkey", "left_semi").select(F.col("l_suppkey").alias("suppkey")).distinct()


@query("range_join", """WITH q AS (SELECT o_custkey AS k, o_orderkey, o_orderkey // 100 AS g FROM orders), r AS (SELECT c_custkey, c_custkey % 150 AS g, c_custkey * 10 AS lo, c_custkey * 10 + 25 AS hi FROM customer)
SELECT c_custkey, count(*) AS orders FROM orders JOIN r ON o_orderkey BETWEEN lo AND hi GROUP BY 1""")
def range_join(t: Tables) -> DataFrame:
    """SQL-3: ranges cut into 256-wide buckets, so the join has an equi key."""
    width = 256
    ranges = t.customer.select("c_custkey", (F.col("c_custkey") * 10).alias("lo"), (F.col("c_custkey") * 10 + 25).alias("hi"))
    cut = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    points = t.orders.select("o_orderkey", F.floor(F.col("o_orderkey") / width).alias("bucket"))
    return points.join(cut, "bucket").filter(F.col("o_orderkey").between(F.col("lo"), F.col("hi"))) \
        .groupBy("c_custkey").agg(F.count("*").alias("orders"))


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def order_limit(t: Tables) -> DataFrame:
    """SQL-7: a top-k report."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
