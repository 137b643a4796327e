"""Source-code and request tables that Spark derives from the driver tables.

The driver tables hold no source code, so every document is rendered as one
source file: each text line becomes a declared function, each word a call.
``doc_id mod 4`` picks Java, Python, TypeScript or Go.  The whole text is used
and the corpus grows with ``documents``.  The same rendering exists as SQL
(``CODE_SQL``), which is what the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.lines import files_from

#: language slot -> (path, preamble lines, method header, call prefix, method end, tail lines)
_T = "\t"
TEMPLATES = {
    0: dict(
        language="java",
        path="{src}/Doc{id}.java",
        head=["package {src};", "import {src}.Doc{a};", "import {src}.Doc{b};", "import java.util.List;",
              "/* generated { from", " * document {id} */", "@Generated", "public class Doc{id} {",
              '    private String mark = "} {";'],
        method="    public void m_{w}(String a) {", end="    }", indent="        ", stop=";",
        tail=["}"]),
    1: dict(
        language="python",
        path="{src}/doc_{id}.py",
        head=["import os", "from {src}.doc_{a} import helper", "from .doc_{b} import other", "", "class Doc{id}:",
              '    """Document {id}', "    not_a_call(1)", '    """'],
        method="    def m_{w}(self, a):", end="        pass", indent="        ", stop="",
        tail=["", "def run{id}():", "    return getattr(Doc{id}, 'x')(1)"]),
    2: dict(
        language="typescript",
        path="{src}/doc{id}.ts",
        head=["import React from 'react';", "import { helper } from './doc{a}';",
              "const other = require('./doc{b}');", "// { not code", "export class Doc{id} {"],
        method="  m_{w}(a: string): void {", end="  }", indent="    ", stop=";",
        tail=["}", "export const run{id} = (x) => {", "  return handlers[x](1);", "};"]),
    3: dict(
        language="go",
        path="{src}/doc{id}.go",
        head=["package {src}", 'import "fmt"', "// document {id}"],
        method="func (d *Doc) m_{w}(a int) {", end="}", indent=_T, stop="",
        tail=["// end"]),
}


def _fill_spark(text: str, holes: dict[str, Column]) -> Column:
    out: Column | None = None
    parts, rest = [], text
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in holes if "{" + k + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(holes[key])
        rest = rest[at + len(key) + 2:]
    out = F.concat(*parts) if parts else F.lit("")
    return out


def _fill_sql(text: str, holes: dict[str, str]) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for key, sql in holes.items():
        out = out.replace("{" + key + "}", "' || " + sql + " || '")
    return "(" + out + ")"


def words_of(text: Column) -> Column:
    """ASCII letter runs of a text line, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def code_files(documents: DataFrame) -> DataFrame:
    """Every document as one source file (the ``files`` table of the code queries)."""
    lines = F.split(F.col("text"), "\n")
    slot = F.col("doc_id") % 4

    def render(t: dict) -> Column:
        holes = {
            "src": F.col("source"), "id": F.col("doc_id").cast("string"),
            "a": F.abs(F.col("doc_id") - 4).cast("string"), "b": F.abs(F.col("doc_id") - 80).cast("string"),
        }

        def body(line: Column) -> Column:
            words = words_of(line)
            first = F.coalesce(F.get(words, F.lit(0)), F.lit("blank"))
            header = _fill_spark(t["method"], {"w": first})
            calls = F.transform(words, lambda w, i: F.when(
                i % 2 == 0, F.concat(F.lit(t["indent"]), w, F.lit("(a)" + t["stop"]))
            ).otherwise(F.concat(F.lit(t["indent"] + "util.m_"), w, F.lit("(a)" + t["stop"]))))
            return F.concat(F.array(header), calls, F.array(F.lit(t["end"])))

        return F.concat(
            F.array(*[_fill_spark(x, holes) for x in t["head"]]),
            F.flatten(F.transform(lines, body)),
            F.array(*[_fill_spark(x, holes) for x in t["tail"]]))

    def pick(build) -> Column:
        out = F.when(slot == 0, build(TEMPLATES[0]))
        for k in (1, 2):
            out = out.when(slot == k, build(TEMPLATES[k]))
        return out.otherwise(build(TEMPLATES[3]))

    def path(t: dict) -> Column:
        return _fill_spark(t["path"], {"src": F.col("source"), "id": F.col("doc_id").cast("string")})

    rendered = documents.select(
        "source", pick(path).alias("path"),
        F.concat(F.array_join(pick(render), "\n"), F.lit("\n")).alias("content"))
    return files_from(rendered, "source", "path", "content")


def text_files(documents: DataFrame) -> DataFrame:
    """Every document as a plain text file."""
    return files_from(
        documents.select("source", "text", F.concat(
            F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"),
            F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")),
        "source", "path", "text")


# ---- the same rendering for the oracles ------------------------------------

def _case(fn) -> str:
    arms = " ".join(f"WHEN {k} THEN {fn(TEMPLATES[k])}" for k in (0, 1, 2))
    return f"(CASE doc_id % 4 {arms} ELSE {fn(TEMPLATES[3])} END)"


_HOLES = {"src": "source", "id": "doc_id::VARCHAR", "a": "abs(doc_id - 4)::VARCHAR", "b": "abs(doc_id - 80)::VARCHAR"}

#: docs(project_id, doc_id, language, path, head, tail): one row per file
#: methods(..., j, w, n_calls, start_line, end_line): one row per text line
#: calls(..., line, call, simple, method): one row per word
CODE_SQL = f"""
docs AS MATERIALIZED (
  SELECT source AS project_id, doc_id, text,
         {_case(lambda t: "'" + t['language'] + "'")} AS language,
         {_case(lambda t: _fill_sql(t['path'], _HOLES))} AS path,
         {_case(lambda t: str(len(t['head'])))} AS head,
         {_case(lambda t: str(len(t['tail'])))} AS tail
  FROM documents),
text_lines AS MATERIALIZED (
  SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS j
  FROM docs),
worded AS MATERIALIZED (
  SELECT * EXCLUDE (raw), list_transform(regexp_extract_all(raw, '[A-Za-z]+'), lambda x: lower(x)) AS words FROM text_lines),
methods AS MATERIALIZED (
  SELECT *, 'm_' || coalesce(words[1], 'blank') AS name, len(words) AS n_calls,
         head + 1 + coalesce(sum(len(words) + 2) OVER (PARTITION BY doc_id ORDER BY j
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_line,
         head + coalesce(sum(len(words) + 2) OVER (PARTITION BY doc_id ORDER BY j
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INT AS end_line
  FROM worded),
totals AS MATERIALIZED (
  SELECT doc_id, any_value(project_id) AS project_id, any_value(path) AS path, any_value(language) AS language,
         any_value(head) AS head, any_value(tail) AS tail, max(end_line) AS last_end
  FROM methods GROUP BY doc_id),
words AS MATERIALIZED (
  SELECT project_id, doc_id, path, language, name AS method, start_line,
         unnest(words) AS w, generate_subscripts(words, 1) AS i FROM methods),
calls AS MATERIALIZED (
  SELECT project_id, doc_id, path, language, method, (start_line + i)::INT AS line,
         CASE WHEN i % 2 = 1 THEN w ELSE 'util.m_' || w END AS to_name,
         CASE WHEN i % 2 = 1 THEN w ELSE 'm_' || w END AS simple
  FROM words)
"""
