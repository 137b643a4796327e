"""Text expressions: lines, trimming, tokens, JSON fields, labels.

Everything here is a native column expression and stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope import params as P

#: whitespace removed by ``strip`` (Spark's own trim removes spaces only)
WHITESPACE = " \t\n\r\f\u000b"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain Column used several times inside a higher-order function is
    evaluated again for every element; a lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text) -> Column:
    return F.btrim(_c(text), F.lit(WHITESPACE))


def is_blank(text) -> Column:
    return strip(text) == ""


def split_lines(text) -> Column:
    """FN-4: split on LF, drop one CR before it and a final empty line."""
    parts = F.split(_c(text), "\r?\n")
    return (
        F.when(_c(text).isNull() | (_c(text) == ""), F.array().cast("array<string>"))
        .when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))
        .otherwise(parts)
    )


def line_range(lines, start, end) -> Column:
    """FN-5: lines ``start..end`` (1-based, inclusive), each ended by LF."""
    picked = F.slice(_c(lines), F.greatest(_c(start), F.lit(1)),
                     F.greatest(_c(end) - _c(start) + 1, F.lit(0)))
    return F.when(F.size(picked) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(picked, "\n"), F.lit("\n")))


def token_estimate(text) -> Column:
    """FN-6: four characters per token, rounded down."""
    return F.floor(F.length(_c(text)) / 4).cast("int")


def indent_width(line) -> Column:
    """FN-7: leading spaces and tabs, a tab counts one."""
    return F.length(_c(line)) - F.length(F.ltrim(_c(line), F.lit(" \t")))


def signature(line) -> Column:
    """FN-8."""
    return F.substring(strip(line), 1, 500)


def head_chars(text, n: int) -> Column:
    """FN-10: first ``n`` characters."""
    return F.substring(_c(text), 1, n)


def content_md5(content) -> Column:
    """FN-2."""
    return F.md5(_c(content))


def archive_sha256(content) -> Column:
    """FN-3."""
    return F.sha2(_c(content), 256)


def conversation_title(current, first_question) -> Column:
    """FN-11: keep a real title, else the question's first line, 40 chars."""
    first_line = F.element_at(F.split(strip(first_question), "\r?\n"), 1)
    unset = _c(current).isNull() | is_blank(current) | (_c(current) == P.DEFAULT_TITLE)
    return F.when(unset, head_chars(strip(first_line), P.TITLE_CHARS)).otherwise(_c(current))


def millis(ts) -> Column:
    """Epoch milliseconds of a timestamp with or without zone (session zone UTC)."""
    return F.unix_millis(_c(ts).cast("timestamp"))


def relative_time(ts, now) -> Column:
    """FN-12: age label; ``now`` is an argument so that runs are repeatable."""
    def micros(value):
        return F.unix_micros(_c(value).cast("timestamp"))

    minutes = F.floor((micros(now) - micros(ts)) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(_c(ts).isNull(), "")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit(" day ago")))
        .when(days < 30, F.date_format(_c(ts), "MMM d"))
        .otherwise(F.date_format(_c(ts), "MMM yyyy"))
    )


def relative_time_text(ts_text, now) -> Column:
    """FN-12 on text dates: an unreadable date gives an empty label."""
    return relative_time(F.try_to_timestamp(_c(ts_text)), now)


# Provider messages that mean "prompt too long" / "slow down".
CONTEXT_MARKERS = (
    "context length", "context_length", "maximum context", "max context",
    "reduce the length", "too many tokens", "prompt is too long",
    "input is too long", "string is too long",
    "exceeds the maximum number of tokens",
)
RATE_MARKERS = ("rate limit", "rate_limit", "too many requests")


def failure_class(status, message) -> Column:
    """FN-16: ``rate_limited`` / ``context_too_large`` / ``other``."""
    text = F.lower(F.coalesce(_c(message), F.lit("")))

    def mentions(markers):
        return text.rlike("|".join(markers))

    return (
        F.when((_c(status) == 429) | mentions(RATE_MARKERS), "rate_limited")
        .when((_c(status) == 413) | mentions(CONTEXT_MARKERS), "context_too_large")
        .otherwise("other")
    )


def json_text(payload, field: str) -> Column:
    """FN-18: string field of a JSON object, empty when absent or not JSON."""
    return F.coalesce(F.get_json_object(_c(payload), f"$.{field}"), F.lit(""))


def answer_text(payload) -> Column:
    """FN-18 for final answers: plain text payloads pass through trimmed."""
    text = strip(payload)
    return (
        F.when(_c(payload).isNull() | (text == ""), "")
        .when(~text.startswith("{"), text)
        .otherwise(json_text(payload, "answer"))
    )


def cost_usd(input_tokens, output_tokens, input_price, output_price) -> Column:
    """FN-14: prices are per million tokens; an unknown model costs nothing."""
    return F.coalesce(
        _c(input_tokens) / F.lit(1_000_000.0) * _c(input_price)
        + _c(output_tokens) / F.lit(1_000_000.0) * _c(output_price),
        F.lit(0.0),
    )


def overall_progress(percent) -> Column:
    """STR-5: file progress 0..100 mapped to the 45..80 part of the job bar."""
    return (F.lit(45) + F.floor(_c(percent) * F.lit(0.35) + F.lit(0.5))).cast("int")


#: anonymous regular expressions of the request routes
CHAT_ROUTE = r"^/api/projects/[^/]+/conversations(/[^/]+)?/messages(/stream)?$"
AGENT_ROUTE = r"^/api/projects/[^/]+/agent/.*$"
SEARCH_ROUTE = r"^/api/projects/[^/]+/search$"
AUTH_ROUTES = ("/api/auth/login", "/api/auth/register", "/api/auth/resend-verification")


def route_bucket(method, uri) -> Column:
    """FN-15: quota family of a request, null when unlimited."""
    path = _c(uri)
    return (
        F.when(path.isin(*AUTH_ROUTES), "AUTH")
        .when((_c(method) == "POST") & path.rlike(CHAT_ROUTE), "CHAT")
        .when(path.rlike(AGENT_ROUTE), "AGENT")
        .when(path.rlike(SEARCH_ROUTE), "SEARCH")
    )
