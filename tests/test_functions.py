"""Paths, hygiene, text and citation grammar: small hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import paths as PA
from corpuscope.functions import text as TX
from corpuscope.functions.languages import language_of
from corpuscope.sources import readers


@pytest.mark.parametrize("path,expected", [
    ("src/main/Foo.java", "src/main/Foo.java"), ("src\\main\\.\\Foo.java", "src/main/Foo.java"),
    ("", ""), (".", ""), (" a//b ", "a/b"), ("/etc/passwd", None), ("C:/Windows", None), ("src/..", None),
    ("a/../../b", None), ("./", "."),
])
def test_tool_path(one, path, expected):
    assert one(PA.safe_path("p"), p=path) == expected


@pytest.mark.parametrize("path,expected", [
    ("a/b", "a/b"), ("a\\b", "a/b"), ("a/./b", "a/./b"), (" ", None), ("/a", None), ("x:y", None), ("a/../b", None),
])
def test_backend_path(one, path, expected):
    assert one(PA.safe_path("p", rule="backend"), p=path) == expected


@pytest.mark.parametrize("path,ignored", [
    (".env", True), ("config\\.env", True), ("certs/SERVER.PEM", True), (".env.example", True),
    ("app/id_rsa", True), ("infra/x.tfstate.backup", True), ("src/key.ts", False), ("src/environment.py", False),
    ("node_modules/a.js", True), ("Node_Modules/a.js", False), ("a/build/x.c", True), ("rebuild/x.c", False),
    ("img/A.PNG", True), ("credentials", True), ("credentials.py", False),
])
def test_ignored(one, path, ignored):
    assert one(PA.is_ignored("p"), p=path) is ignored and readers.ignored(path) is ignored


@pytest.mark.parametrize("path,out", [("a/b", False), ("../a", True), ("a/../b", False), ("a/../../b", True), ("/a", True)])
def test_escape(one, path, out):
    assert one(PA.escapes_root("p"), p=path) is out


@pytest.mark.parametrize("path,language", [
    ("A.java", "java"), ("a.JSX", "tsx"), ("a.pyi", "python"), ("x.tar.gz", "unknown"), ("noext", "unknown"),
    ("a.", "unknown"), ("dir.d/Makefile", "unknown"), ("a.hpp", "cpp"),
])
def test_language(one, path, language):
    assert one(language_of("p"), p=path) == language


@pytest.mark.parametrize("text,lines", [
    ("", []), ("\n", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("a\r", ["a\r"]),
])
def test_split_lines(one, text, lines):
    assert one(TX.split_lines("t"), t=text) == lines


def test_line_range_and_tokens(one):
    assert one(TX.line_range(F.split("t", "\n"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc\n"
    assert one(TX.token_estimate("t"), t="abcdefg") == 1
    assert one(TX.indent_width("t"), t="\t  x ") == 3


def test_citation_key_strips_every_leading_dot_and_slash(one):
    assert one(PA.citation_key("p"), p="./.github\\x") == "github/x"


def test_fold_dots_and_natural_key(one):
    assert one(PA.fold_dots("p"), p="a/./b/../c/../../d") == "d"
    assert one(PA.fold_dots("p"), p="../a/..") == ".."
    assert one(PA.natural_key("p"), p="f2") < one(PA.natural_key("p"), p="f10")


@pytest.mark.parametrize("ts,label", [
    ("2024-05-10 11:59:30", "just now"), ("2024-05-10 11:30:00", "30 min ago"), ("2024-05-10 02:00:00", "10 hr ago"),
    ("2024-05-08 12:00:00", "2 day ago"), ("2024-04-20 12:00:00", "Apr 20"), ("2023-12-01 00:00:00", "Dec 2023"), ("x", ""),
])
def test_relative_time(one, ts, label):
    assert one(TX.relative_time_text("t", F.lit("2024-05-10 12:00:00").cast("timestamp")), t=ts) == label


def test_failure_and_routes(one):
    assert one(TX.failure_class(F.lit(429), F.lit("")), t=1) == "rate_limited"
    assert one(TX.failure_class(F.lit(None).cast("int"), F.lit("Please reduce the length")), t=1) == "context_too_large"
    assert one(TX.failure_class(F.lit(500), F.lit("boom")), t=1) == "other"
    route = TX.route_bucket(F.col("m"), F.col("u"))
    assert one(route, m="POST", u="/api/projects/1/conversations/messages") == "CHAT"
    assert one(route, m="GET", u="/api/projects/1/conversations/messages") is None
    assert one(route, m="POST", u="/api/auth/login") == "AUTH"


def test_lenient_and_strict_text(spark):
    from corpuscope.sources.readers import lenient_text, strict_text

    frame = spark.createDataFrame([(b"ok\xffgo",), ("é�".encode(),)], "b binary")
    rows = frame.select(lenient_text("b").alias("l"), strict_text("b").alias("s")).collect()
    assert [(r.l, r.s) for r in rows] == [("okgo", None), ("é�", "é�")]
