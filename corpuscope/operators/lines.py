"""The ``lines`` table: one row per source line, plus the lexed form.

``files`` is the input everywhere: one row per file with ``project_id``,
``file_id``, ``path``, ``language`` and ``content``.  A file's text moves
through one shuffle (``repartition("file_id")``); everything after it --
explode, windows by file -- reuses that partitioning without another one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.languages import SYMBOL_LANGUAGES, language_of
from corpuscope.functions.text import content_md5, split_lines
from corpuscope.session import dealt, free_unused

_STRING = r"""(?P<q>["'{tick}])(?:\\[^\n]|(?!(?P=q))[^\\\n])*(?:(?P=q)|\\?(?=\n|\Z))"""
_BRACE_TOKENS = re.compile(
    r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + _STRING.format(tick="`"), re.S)
_INDENT_TOKENS = {
    # a '#' in the first column is kept as code unless strict
    False: re.compile(r"(?<=[^\n])\#[^\n]*|" + _STRING.format(tick="")),
    True: re.compile(r"\#[^\n]*|" + _STRING.format(tick="")),
}
_ESCAPE = re.compile(r"\\[^\n]?")
_TRIPLE = re.compile(r"(\"\"\"|''').*?(?:\1|\Z)", re.S)

LEX_TYPE = "code string, docstring array<boolean>"
#: text of the files that one task takes apart into lines
TASK_BYTES = 8 << 20
#: the number of tasks follows from the text of one file in so many; it changes no row
SIZED = 16


def _blank_brace(text: str) -> str:
    def keep_newlines(match: re.Match) -> str:
        token = match.group()
        return "\n" * token.count("\n") if token.startswith("/*") else ""

    return _BRACE_TOKENS.sub(keep_newlines, text)


def _strip_comments(text: str, strict: bool) -> str:
    def clean(match: re.Match) -> str:
        token = match.group()
        return "" if token.startswith("#") else _ESCAPE.sub("", token)

    return _INDENT_TOKENS[strict].sub(clean, text)


def _docstring_lines(text: str) -> list[bool]:
    mask = [False] * (text.count("\n") + 1)
    line, seen = 0, 0
    for match in _TRIPLE.finditer(text):
        line += text.count("\n", seen, match.start())
        last = line + text.count("\n", match.start(), match.end())
        closed = match.end() - match.start() >= 6 and match.group().endswith(match.group(1))
        if last > line or not closed:
            mask[line:last + 1] = [True] * (last + 1 - line)
        line, seen = last, match.end()
    return mask


def _lexer(strict: bool):
    """IDX-1, IDX-2, IDX-14: the only step with lexical state across lines.

    Arrow batches in and out, one text per file (lines are split in the JVM);
    the scanning is one compiled regular expression, not a character loop.
    """

    @F.pandas_udf(LEX_TYPE)
    def lex(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, languages in batches:
            code, masks = [], []
            for content, language in zip(contents, languages):
                text = (content or "").replace("\r\n", "\n")
                if language == "python":
                    code.append(_strip_comments(text, strict))
                    masks.append(_docstring_lines(text))
                else:
                    code.append(_blank_brace(text))
                    masks.append([])
            yield pd.DataFrame({"code": code, "docstring": masks})

    return lex


def files_from(df: DataFrame, project: str, path: str, content: str) -> DataFrame:
    """Any table with a project, a path and a text column as ``files``."""
    return df.select(
        F.col(project).cast("string").alias("project_id"),
        F.md5(F.concat_ws("/", F.col(project).cast("string"), F.col(path))).alias("file_id"),
        F.col(path).alias("path"),
        F.col(content).alias("content"),
        content_md5(F.col(content)).alias("content_hash"),
        F.octet_length(F.col(content)).cast("long").alias("size_bytes"),
        language_of(F.col(path)).alias("language"),
    )


def text_lines(files: DataFrame) -> DataFrame:
    """FN-4 as a table; a narrow explode, no shuffle."""
    return files.select(
        "project_id", "file_id", "path",
        F.posexplode(split_lines("content")).alias("pos", "raw"),
    ).select("project_id", "file_id", "path", (F.col("pos") + 1).alias("line_no"), "raw")


def line_counts(files: DataFrame) -> DataFrame:
    """AGG-13."""
    return files.select("project_id", "file_id", "path",
                        F.size(split_lines("content")).alias("n_lines"))


def lex(files: DataFrame, strict: bool = False, tasks: list[int] | None = None) -> DataFrame:
    """Symbol-capable files with their lexed form (in so many ``tasks``, dealt by file); files that have it stay as they are."""
    if "lexed" in files.columns:
        return files
    # a one-row generator: a text that is an expression is computed once, not for each use
    texts = files.filter(F.col("language").isin(*SYMBOL_LANGUAGES)).select(
        "project_id", "file_id", "path", "language", F.explode(F.array("content")).alias("content"))
    if tasks:
        texts = texts.repartition(*tasks, "file_id")
    return texts.select("project_id", "file_id", "path", "language", "content", _lexer(strict)("content", "language").alias("lexed"))


def dealt_by_file(df: DataFrame, tasks: int, moved: bool = False) -> DataFrame:
    """Rows written once, in ``tasks`` buckets by file: joins, windows and groups by file move none of them again.

    ``moved`` rows lie in as many tasks by file already, which a Python step hides from the plan.
    """
    rows = df if moved else df.repartition(tasks, "file_id")
    out = dealt(rows.withColumn("tasks", F.lit(tasks)), "file_id", tasks)
    free_unused(df.sparkSession)  # the shuffle that led here
    return out


def lex_once(files: DataFrame, strict: bool = False) -> DataFrame:
    """The lexed files, written once: every operator that takes files takes them as well, and lexes nothing again.

    They are dealt by file to tasks of bounded text, so no later step moves a text. Texts are dealt before they are lexed, so a lexer
    is handed a task's text at most, however many files it comes from.
    """
    tasks = task_count(files)
    return dealt_by_file(lex(files, strict, [tasks]).withColumn("n_bytes", F.octet_length("content").cast("long")), tasks)


def task_count(files: DataFrame) -> int:
    """Tasks that the texts of the symbol-capable files are dealt to, reckoned from one file in ``SIZED``."""
    share = files.filter(F.col("language").isin(*SYMBOL_LANGUAGES) & (F.pmod(F.xxhash64("file_id"), F.lit(SIZED)) == 0))
    return _tasks(files, SIZED * (share.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0))


def _tasks(files: DataFrame, size: int) -> int:
    return max(3 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def file_tasks(files: DataFrame) -> list[int]:
    """Tasks that rows written once by file are dealt to, each of bounded text; none named for others.

    Lines are many times as large in memory as the compressed shuffle, by whose bytes adaptive execution would merge partitions.
    Files whose text is over twice what was reckoned with are dealt anew.
    """
    if "tasks" not in files.columns:
        return []
    first = files.select("tasks").first()
    if "n_bytes" not in files.columns:
        return [first[0]] if first else []
    needed = _tasks(files, files.agg(F.sum("n_bytes")).first()[0] or 0)
    return [first[0] if first and needed <= 2 * first[0] else needed]


def lexed_files(files: DataFrame, strict: bool = False, tasks: list[int] | None = None) -> DataFrame:
    """Symbol-capable files with ``raw``/``code`` line arrays and the mask, dealt by file (to so many ``tasks``)."""
    tasks = file_tasks(files) if tasks is None else tasks
    return (
        # lex first: a Python node hides the partitioning below it, so the one
        # shuffle by file comes after it and serves every later window; files written once are dealt so already
        lex(files, strict).repartition(*tasks, "file_id")
        .withColumn("raw", split_lines("content"))
        .select("project_id", "file_id", "path", "language", "raw",
                F.split("lexed.code", "\n").alias("code"), F.col("lexed.docstring").alias("docstring"))
    )


def code_lines(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row per line with ``raw``, ``code``, ``in_docstring``."""
    return lines_of(lexed_files(files, strict))


def lines_of(lexed: DataFrame, *extra: str) -> DataFrame:
    """One row per line of :func:`lexed_files`. ``extra`` are columns of the file that its lines keep; of ``owners``, an array, a line has its own."""
    zipped = ["raw", "code", F.col("docstring").alias("doc"), *(c for c in ("owners",) if c in lexed.columns)]
    return lexed.select(
        "project_id", "file_id", "path", "language", *extra,
        F.size("raw").alias("n_lines"),
        F.posexplode(F.arrays_zip(*zipped)).alias("pos", "line"),
    ).filter("pos < n_lines").select(
        "project_id", "file_id", "path", "language", *extra, "n_lines", (F.col("pos") + 1).alias("line_no"),
        *(F.col("line.owners").alias("owner") for c in zipped[3:]),
        F.col("line.raw").alias("raw"),
        F.coalesce("line.code", F.lit("")).alias("code"),
        F.coalesce("line.doc", F.lit(False)).alias("in_docstring"),
    )
