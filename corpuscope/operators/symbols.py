"""Symbols and structural blocks (IDX-3 .. IDX-9, IDX-15).

Line-level facts (depth, declarations, block ends, decorator runs) are windows
over the lines of a file.  Only the few candidate rows of a file then meet a
small scope walk, which decides nesting in one linear pass: the walk needs the
already-truncated end of the enclosing scope, which no window can see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscope import params as P
from corpuscope.functions import grammar as G
from corpuscope.functions.text import indent_width, signature, strip
from corpuscope.operators.lines import lexed_files, lines_of

#: walk output: one row per symbol, block or owner step
ITEM_SCHEMA = (
    "project_id string, file_id string, language string, item string, seq int, name string, kind string, "
    "parent_symbol string, start_line int, end_line int, signature string"
)
_ITEM_ARROW = pa.schema(
    [(name, pa.int32() if kind == "int" else pa.string())
     for name, kind in (column.split() for column in ITEM_SCHEMA.split(", "))])


def _file():
    return W.partitionBy("file_id").orderBy("line_no")


def _up_to_here():
    return _file().rowsBetween(W.unboundedPreceding, W.currentRow)


def _before():
    return _file().rowsBetween(W.unboundedPreceding, -1)


def _from_here():
    """"Nearest following" as a running value over the reversed order: linear,
    where a frame up to unbounded-following is recomputed for every row."""
    return (
        W.partitionBy("file_id").orderBy(F.col("line_no").desc())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )


def with_depth(lines: DataFrame) -> DataFrame:
    """IDX-3: ``depth_before`` / ``depth_after`` per line of brace languages."""
    return (
        lines.withColumn("delta", G.brace_delta("code"))
        .withColumn("depth_after", F.sum("delta").over(_up_to_here()).cast("int"))
        .withColumn("depth_before", F.col("depth_after") - F.col("delta"))
    )


def brace_candidates(lines: DataFrame) -> DataFrame:
    """IDX-4 + IDX-5: declarations with everything their end depends on.

    ``event_*`` is the first line at or after the header that changes the depth
    or holds a semicolon.  If it opens a body, ``body_end`` is the next line
    that comes back to the depth before it: an opener joins the lines of that
    depth as a row of its own, and its successor there is the closing line.
    """
    facts = F.struct(
        G.brace_delta("code").alias("delta"), F.col("code").contains(";").alias("semi"), G.declaration().alias("decl"))
    # a one-row generator computes the facts once: a filter on them cannot be
    # pushed below it.  Only lines that change the depth, declare something or may
    # end an open header matter, and the windows below sort just those, narrow.
    kept = (
        lines.filter(F.col("language") != "python")
        .select("project_id", "file_id", "language", "n_lines", "line_no", "raw", "open_headers", F.inline(F.array(facts)))
        .withColumn("moves", F.col("delta") != 0)
        .filter("moves OR decl IS NOT NULL OR (semi AND open_headers)")
        .select("project_id", "file_id", "language", "n_lines", "line_no", "delta", "semi", "decl", "moves",
                F.when(F.col("decl").isNotNull(), signature("raw")).alias("signature"))
    )
    marked = (
        kept.withColumn("depth_after", F.sum("delta").over(_up_to_here()).cast("int"))
        .withColumn("depth_before", F.col("depth_after") - F.col("delta"))
    )
    opens = F.col("delta") > 0
    # (level, self): an opener counts at both of its depths, others at the depth after
    roles = F.when(opens, F.array(
        F.struct(F.col("depth_before").alias("level"), F.lit(True).alias("self")),
        F.struct(F.col("depth_after").alias("level"), F.lit(False).alias("self")),
    )).otherwise(F.array(F.struct(
        F.when(F.col("moves"), F.col("depth_after")).alias("level"), F.lit(True).alias("self"))))
    same_depth = W.partitionBy("file_id", "level").orderBy("line_no")
    return (
        marked.select("*", F.inline(roles))
        .withColumn("next_same", F.lead("line_no").over(same_depth))
        .filter("self")
        .withColumn("event", F.last(
            F.when((F.col("delta") != 0) | F.col("semi"),
                   F.struct("line_no", "delta", "semi", F.col("next_same").alias("body_end"))),
            ignorenulls=True).over(_from_here()))
        .filter("decl IS NOT NULL")
        .select(
            "project_id", "file_id", "language", "n_lines", "line_no", "signature",
            F.col("depth_before").alias("level"),
            F.col("decl.name").alias("name"), F.col("decl.kind").alias("kind"),
            F.col("event.line_no").alias("event_line"), F.col("event.delta").alias("event_delta"),
            F.col("event.semi").alias("event_semi"), F.col("event.body_end").alias("body_end"),
        )
    )


def open_headers() -> Column:
    """Whether a brace-language file has a header that neither opens a body nor closes on its own line.

    Lines with a semicolon end such headers only; most files have none, and then those lines are not needed.
    """
    def is_open(code: Column) -> Column:
        return ~code.contains(";") & (G.brace_delta(code) == 0) & G.declaration(code).isNotNull()

    return F.exists("code", is_open)


def indent_candidates(lines: DataFrame) -> DataFrame:
    """IDX-4 + IDX-6: declaration lines and the lines that can end a block.

    A block ends before the first non-blank line at or left of its header.
    Such a line is either less indented than the non-blank line before it, or
    directly follows the header; only those rows are kept, each with
    ``prev_line``, the last non-blank line before it.
    """
    run_start = F.col("decorator") & ~F.coalesce(F.lag("decorator").over(_file()), F.lit(False))
    code, tail = F.col("code"), F.element_at(F.split(F.col("code"), ":"), -1)
    facts = F.struct(
        (code.contains("@") & code.rlike(G.PY_DECORATOR)).alias("decorator"), (strip("code") == "").alias("blank"),
        indent_width("code").alias("level"), G.declaration().alias("decl"))
    declares = F.col("decl").isNotNull()
    # as for braces: the facts are computed once, and the windows sort them without the lines' text
    seen = (
        lines.filter(F.col("language") == "python")
        .select("project_id", "file_id", "language", "n_lines", "line_no", "raw", "code", F.inline(F.array(facts)))
        .select("project_id", "file_id", "language", "n_lines", "line_no", "decorator", "blank", "level", "decl",
                F.when(F.col("decorator") | declares, signature("raw")).alias("signature"),
                F.when(declares, code.contains(":") & (strip(tail) != "")).alias("one_liner"))
    )
    return (
        seen.withColumn("run_text", F.when(run_start, F.col("signature")))
        .withColumn("run", F.struct(
            (F.coalesce(F.last(F.when(~F.col("decorator"), F.col("line_no")), ignorenulls=True)
                        .over(_before()), F.lit(0)) + 1).alias("line"),
            F.last("run_text", ignorenulls=True).over(_before()).alias("text")))
        .filter(~F.col("blank"))
        .withColumn("prev", F.lag(F.struct("line_no", "level", "decl")).over(_file()))
        .withColumn("tail_line", F.max("line_no").over(W.partitionBy("file_id")))
        .filter(declares | (F.col("level") < F.col("prev.level")) | F.col("prev.decl").isNotNull())
        .select(
            "project_id", "file_id", "language", "n_lines", "line_no", "level",
            F.col("decl.name").alias("name"), F.col("decl.kind").alias("kind"),
            F.when(declares, F.col("signature")).alias("signature"),
            F.col("prev.line_no").alias("prev_line"), "tail_line",
            F.col("run.line").alias("decorated_from"), F.col("run.text").alias("decorated_text"), "one_liner",
        )
    )


# --------------------------------------------------------------------------
# scope walks: small helpers over the candidate rows of one file
# --------------------------------------------------------------------------

@dataclass
class _Scope:
    """A range whose members sit at ``level``.

    ``cursor`` is the line where the next gap starts, None before the first
    member; ``blocked`` is the last line covered by an accepted member.
    """

    level: int | None
    to: int | None
    end: int | None = None
    name: str | None = None
    kind: str | None = None
    parent: str | None = None
    start: int = 1
    cursor: int | None = None
    blocked: int = 0


@dataclass
class _Found:
    """Symbols, blocks and gaps of one file."""

    n_lines: int
    symbols: list = field(default_factory=list)
    blocks: list = field(default_factory=list)

    def gap(self, scope: _Scope, last: int) -> None:
        if last >= scope.cursor:
            self.blocks.append(("gap", scope.name, scope.kind, None, scope.cursor, last))

    def member(self, scope: _Scope, line: int, gap_end: int) -> None:
        """The first member closes its container's header block."""
        if scope.cursor is None:
            self.blocks.append(
                ("block", scope.name, scope.kind, scope.parent, scope.start, line - 1))
        else:
            self.gap(scope, gap_end)

    def close(self, scope: _Scope) -> None:
        if scope.cursor is None:
            self.blocks.append(
                ("block", scope.name, scope.kind, scope.parent, scope.start, scope.end))
        else:
            self.gap(scope, scope.to)

    def owners(self) -> tuple[np.ndarray, list]:
        """IDX-15: number of each line's innermost symbol (later start wins), from 1, and the symbols in that order."""
        owner = np.zeros(self.n_lines + 2, dtype=np.int32)
        ordered = sorted(self.symbols, key=lambda s: s[3])
        for number, sym in enumerate(ordered, 1):
            owner[sym[3]:min(sym[4], self.n_lines) + 1] = number
        return owner, ordered

    def owner_steps(self):
        """Lines where the innermost symbol changes."""
        owner, ordered = self.owners()
        for line in np.flatnonzero(np.diff(owner)) + 1:
            number = owner[line]
            yield int(line), ordered[number - 1][0] if number else None

    def rows(self):
        for seq, (name, kind, parent, start, end, text) in enumerate(self.symbols):
            yield "symbol", seq, name, kind, parent, start, end, text
        for seq, (item, name, kind, parent, start, end) in enumerate(
                sorted(self.blocks, key=lambda b: b[4])):
            yield item, seq, name, kind, parent, start, end, None
        for seq, (line, name) in enumerate(self.owner_steps()):
            yield "owner", seq, name, None, None, line, None, None


def _walk_braces(rows: list[dict], n_lines: int) -> _Found:
    found = _Found(n_lines)
    stack = [_Scope(0, n_lines, cursor=1)]
    for r in rows:
        line = r["line_no"]
        while len(stack) > 1 and line > stack[-1].to:
            found.close(stack.pop())
        scope = stack[-1]
        if r["level"] != scope.level or line <= scope.blocked:
            continue
        end, event = line, r["event_line"]
        if event is not None and event <= min(scope.to, line + P.HEADER_SCAN_LINES):
            if r["event_delta"] > 0:
                end = r["body_end"]
                end = scope.to if end is None else min(end, scope.to)
            elif r["event_semi"]:
                end = event
        found.member(scope, line, line - 1)
        kind = "constructor" if r["name"] == scope.name else r["kind"]
        found.symbols.append((r["name"], kind, scope.name, line, end, r["signature"]))
        scope.blocked, scope.cursor = end, end + 1
        if kind in G.CONTAINER_KINDS:
            # members lie before the closing line, which then is in no block
            stack.append(_Scope(r["level"] + 1, end - 1, end, r["name"], kind, scope.name, line))
        else:
            found.blocks.append(("block", r["name"], kind, scope.name, line, end))
    while stack[1:]:
        found.close(stack.pop())
    found.gap(stack[0], n_lines)
    return found


def _walk_indents(rows: list[dict], n_lines: int) -> _Found:
    found = _Found(n_lines)
    root = _Scope(0, n_lines, cursor=1)
    open_blocks: list[tuple] = []  # (header indent, own scope, enclosing scope, symbol index)

    def finish(end: int) -> None:
        _, own, outer, index = open_blocks.pop()
        name, kind, parent, start, header, text = found.symbols[index]
        end = max(end, header)
        found.symbols[index] = (name, kind, parent, start, end, text)
        outer.blocked, outer.cursor = end, end + 1
        if own is None:
            found.blocks.append(("block", name, kind, parent, start, end))
        else:
            own.to = own.end = end
            found.close(own)

    for r in rows:
        line, level = r["line_no"], r["level"]
        while open_blocks and open_blocks[-1][0] >= level:
            finish(r["prev_line"])
        scope = open_blocks[-1][1] if open_blocks else root
        if scope is None:
            continue  # inside a function body
        if scope.level is None:
            scope.level = level  # the first body line fixes the member indent
        if level < scope.level and scope.cursor is not None:
            scope.blocked = n_lines  # left of the members: the scan stops here
        if r["name"] is None or level != scope.level or line <= scope.blocked:
            continue
        first = scope.cursor is None
        decorated = not first and r["decorated_from"] < line
        start = r["decorated_from"] if decorated else line
        text = r["decorated_text"] if decorated else r["signature"]
        found.member(scope, line, start - 1)
        found.symbols.append((r["name"], r["kind"], scope.name, start, line, text))
        scope.blocked, scope.cursor = line, line + 1
        own = None
        if r["kind"] == "class":
            own = _Scope(None, None, None, r["name"], "class", scope.name, start)
        open_blocks.append((level, own, scope, len(found.symbols) - 1))
        if r["one_liner"]:
            finish(line)
    while open_blocks:
        finish(rows[-1]["tail_line"])
    found.gap(root, n_lines)
    return found


def _file_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one file at a time from batches sorted by file and line."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and run[0]["file_id"] != row["file_id"]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _walker(walk, columns: list[str]):
    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for run in _file_runs(batches):
            head = run[0]
            ids = (head["project_id"], head["file_id"], head["language"])
            for item in walk(run, head["n_lines"]).rows():
                out.append(dict(zip(columns, ids + item)))
            if len(out) >= 8192:
                yield pa.RecordBatch.from_pylist(out, schema=_ITEM_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ITEM_ARROW)

    return nest


def structure(files: DataFrame, strict: bool = False) -> DataFrame:
    """All items of the symbol-capable files: symbols, blocks, gaps, owner steps.

    Files without any candidate row have no items; their single gap is added
    where chunks are built. Of rows that :func:`scan.scan` made of files, they are those.
    """
    if "item" in files.columns:
        return files.filter(F.col("item") != "reference").drop("path", "is_dynamic", "tasks")
    lexed = lexed_files(files, strict)
    braces = lexed.filter(F.col("language") != "python").withColumn("open_headers", open_headers())
    columns = _ITEM_ARROW.names
    parts = []
    for candidates, walk in ((brace_candidates(lines_of(braces, "open_headers")), _walk_braces),
                             (indent_candidates(lines_of(lexed.filter(F.col("language") == "python"))), _walk_indents)):
        ordered = candidates.sortWithinPartitions("file_id", "line_no")
        parts.append(ordered.mapInArrow(_walker(walk, columns), ITEM_SCHEMA))
    return parts[0].unionByName(parts[1])


def symbols_of(items: DataFrame) -> DataFrame:
    """IDX-8: the ``code_symbols`` table."""
    return items.filter(F.col("item") == "symbol").select(
        "project_id", "file_id", "name", "kind", "parent_symbol", "start_line", "end_line", "signature")


def extract_symbols(files: DataFrame, strict: bool = False) -> DataFrame:
    return symbols_of(structure(files, strict))
