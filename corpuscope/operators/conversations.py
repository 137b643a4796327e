"""Conversation windows, summaries and titles (WIN-2 .. WIN-8, WIN-12, FN-11, FN-17).

``messages(conv_id, seq, message_id, role, content)`` are ordered by ``seq``.
A conversation may be arbitrarily long: everything below is either a bounded
top-n per conversation or a combined aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscope import params as P
from corpuscope.functions.text import conversation_title, head_chars, is_blank, strip
from corpuscope.operators.prefix import running_before

#: fixed value: text that replaces an old tool result
TOOL_RESULT_STUB = "[earlier result omitted]"


def ordered_messages(messages: DataFrame) -> DataFrame:
    """WIN-8: oldest first per conversation (global range-partitioned sort)."""
    return messages.orderBy("conv_id", "seq")


def conversation_listing(conversations: DataFrame) -> DataFrame:
    """WIN-8: newest conversation first."""
    return conversations.orderBy(F.desc("updated_at"), "conv_id")


def _summary_cut(messages: DataFrame, conversations: DataFrame, need_summary: bool) -> DataFrame:
    """``seq`` of the message the summary reaches, for conversations having it."""
    pointed = conversations.filter(F.col("summary_through_id").isNotNull())
    if need_summary:
        pointed = pointed.filter(F.col("summary").isNotNull())
    return messages.join(
        pointed.select("conv_id", F.col("summary_through_id").alias("message_id")),
        ["conv_id", "message_id"]).select("conv_id", F.col("seq").alias("cut"))


def live_history(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """WIN-3: messages after the summary pointer; no or unknown pointer: all."""
    cut = _summary_cut(messages, conversations, need_summary=True)
    return messages.join(cut, "conv_id", "left").filter(
        F.col("cut").isNull() | (F.col("seq") > F.col("cut"))).drop("cut")


def history_window(live: DataFrame, questions: DataFrame, conversations: DataFrame,
                   size: int = P.HISTORY_MESSAGES, max_chars: int = P.HISTORY_CHARS) -> DataFrame:
    """WIN-4: ``questions(conv_id, question, regenerate)`` -> history rows.

    At most two trailing messages are dropped, so the last ``size + 2`` rows
    of a conversation decide everything.
    """
    latest = W.partitionBy("conv_id").orderBy(F.desc("seq"))
    tail = live.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= size + 2)
    asked = questions.select("conv_id", strip("question").alias("question"), "regenerate")
    rows = tail.join(asked, "conv_id")
    whole = W.partitionBy("conv_id")
    answer = F.max((F.col("regenerate") & (F.col("back") == 1) & (F.col("role") == "assistant")).cast("int")) \
        .over(whole)
    rows = rows.withColumn("drop_answer", answer)
    same = (F.col("back") == F.col("drop_answer") + 1) & (F.col("role") == "user") \
        & (F.col("content") == F.col("question"))
    rows = rows.withColumn("dropped", F.col("drop_answer") + F.max(same.cast("int")).over(whole))
    kept = rows.filter((F.col("back") > F.col("dropped")) & (F.col("back") <= F.col("dropped") + size)).select(
        "conv_id", "seq", "role", head_chars("content", max_chars).alias("content"))
    summary = (
        conversations.filter(F.col("summary").isNotNull() & ~is_blank("summary"))
        .join(asked.filter(~F.col("regenerate")).select("conv_id"), "conv_id", "left_semi")
        .select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit("system").alias("role"),
                F.concat(F.lit("Earlier discussion summary: "), "summary").alias("content"))
    )
    return kept.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", "content").unionByName(summary)


def summarise_trigger(messages: DataFrame, conversations: DataFrame, mode: str = "reference",
                      size: int = P.HISTORY_MESSAGES, threshold: int = P.SUMMARY_THRESHOLD,
                      budget: int = P.CONTEXT_BUDGET_CHARS) -> DataFrame:
    """WIN-5: one combined aggregate per conversation.

    ``mode="reference"`` counts every old message but the pointer itself;
    ``mode="uncovered"`` counts only old messages after the pointer.
    """
    cut = _summary_cut(messages, conversations, need_summary=mode != "reference")
    counts = messages.join(cut, "conv_id", "left").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("total_chars"),
        F.count_if(F.col("seq") > F.col("cut")).alias("after"), F.max("cut").alias("cut"))
    old = F.greatest(F.col("n") - size, F.lit(0))
    if mode == "reference":
        pending = old - F.when(F.col("cut").isNotNull() & (F.col("after") >= size), 1).otherwise(0)
    else:
        pending = F.when(F.col("cut").isNull(), old).otherwise(F.greatest(F.col("after") - size, F.lit(0)))
    return counts.select(
        "conv_id", pending.alias("old_messages"), "total_chars",
        ((pending > threshold) | (F.col("total_chars") > int(0.7 * budget))).alias("summarise"))


def regenerate_upsert(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """WIN-6: ``answers(conv_id, message_id, content, regenerate)``.

    A regenerated answer replaces a trailing assistant message, any other
    answer is appended.
    """
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct("seq", "role"), "seq").alias("last"))
    placed = answers.join(last, "conv_id", "left").withColumn(
        "replace", F.col("regenerate") & (F.coalesce("last.role", F.lit("")) == "assistant"))
    target = F.coalesce(F.col("last.seq") + F.when(F.col("replace"), 0).otherwise(1), F.lit(0))
    fresh = placed.select("conv_id", target.cast("long").alias("seq"), "message_id",
                          F.lit("assistant").alias("role"), "content", "replace")
    swaps = fresh.filter("replace").select("conv_id", "seq", F.col("content").alias("new_content"))
    kept = messages.join(swaps, ["conv_id", "seq"], "left").select(
        "conv_id", F.col("seq").cast("long").alias("seq"), "message_id", "role",
        F.coalesce("new_content", "content").alias("content"))
    return kept.unionByName(fresh.filter(~F.col("replace")).drop("replace"))


def trim_to_budget(messages: DataFrame, budget: int = P.CONTEXT_BUDGET_CHARS,
                   stub: str = TOOL_RESULT_STUB) -> DataFrame:
    """WIN-7: ``messages(run_id, seq, role, content)``; oldest tool results
    become a stub until the run fits the budget.

    A result is stubbed while no earlier prefix of savings was enough; results
    shorter than the stub can lower the savings again, hence the running peak.
    """
    open_result = (F.col("role") == "tool") & (F.col("content") != stub)
    saving = F.when(open_result, F.length("content") - len(stub)).otherwise(0)
    rows = messages.withColumn("saving", saving)
    totals = messages.groupBy("run_id").agg(F.sum(F.length("content")).alias("total"))
    placed = running_before(rows, "run_id", "seq", "saving").join(totals, "run_id")
    over = F.col("total") - F.lit(budget)
    cut = open_result & (over > 0) & (F.col("peak_before") < over)
    return placed.select("run_id", "seq", "role", F.when(cut, stub).otherwise(F.col("content")).alias("content"),
                         cut.alias("stubbed"))


def resolve_conversation(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """WIN-2: ``requests(request_id, project_id, conv_id)``.

    A given id counts only inside its project; without one the newest
    conversation of the project is used; else a new one is made.
    """
    own = conversations.select("project_id", "conv_id", F.lit(True).alias("known"))
    newest = conversations.groupBy("project_id").agg(
        F.max_by("conv_id", F.struct("updated_at", "conv_id")).alias("newest"))
    rows = requests.join(own, ["project_id", "conv_id"], "left").join(newest, "project_id", "left")
    made = F.sha2(F.concat_ws(":", F.lit("conversation"), "project_id", "request_id"), 256)
    return rows.select(
        "request_id", "project_id",
        F.when(F.col("conv_id").isNotNull(), F.when(F.col("known"), F.col("conv_id").cast("string")))
        .otherwise(F.coalesce(F.col("newest").cast("string"), made)).alias("resolved_id"),
        F.when(F.col("conv_id").isNotNull(), F.when(F.col("known"), "given").otherwise("not_found"))
        .when(F.col("newest").isNotNull(), "newest").otherwise("new").alias("how"))


def titled(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """FN-11 over all conversations: first user message names an untitled one."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("content", "seq").alias("first"))
    return conversations.join(first, "conv_id", "left").withColumn(
        "title", F.when(F.col("first").isNull(), F.col("title"))
        .otherwise(conversation_title("title", "first"))).drop("first")


def backfill_conversations(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN-12: unassigned messages get their project's "Earlier chat" row.

    ``messages(message_id, session_id, conversation_id)``,
    ``sessions(session_id, project_id)``.  Ids are derived, so reruns agree.
    """
    made = F.sha2(F.concat_ws(":", F.lit("earlier"), "project_id"), 256)
    placed = messages.join(sessions.select("session_id", "project_id"), "session_id", "left")
    orphan = F.col("conversation_id").isNull() & F.col("project_id").isNotNull()
    added = placed.filter(orphan).select("project_id").distinct().select(
        made.alias("conversation_id"), "project_id", F.lit("Earlier chat").alias("title"))
    filled = placed.withColumn("conversation_id", F.when(orphan, made).otherwise(F.col("conversation_id")))
    return added, filled.drop("project_id")


def prompt_chars(question: Column, history: Column, context: Column) -> Column:
    """FN-17 over arrays of texts; null texts count nothing."""
    def total(texts):
        return F.aggregate(texts, F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))

    return F.length(question) + total(history) + total(context)
