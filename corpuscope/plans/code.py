"""Registered queries over the derived source corpus: index, graph, imports.

The oracles know the rendering (``CODE_SQL``), so they state what must be found
by construction and do not repeat the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.grammar import BRACE_CALL_NOISE, PY_CALL_NOISE
from corpuscope.operators import chunking as C
from corpuscope.operators import graph as G
from corpuscope.operators.lines import code_lines, lex_once, task_count
from corpuscope.operators.references import references_of
from corpuscope.operators.scan import scan, scan_once
from corpuscope.operators.symbols import structure, symbols_of, with_depth
from corpuscope.plans.derived import CODE_SQL, code_files, words_of
from corpuscope.plans.registry import Tables, query
from corpuscope.session import stored


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


SYMBOLS_SQL = CODE_SQL + """,
symbols AS MATERIALIZED (
  SELECT project_id, path, language, name,
         CASE language WHEN 'python' THEN 'function' WHEN 'go' THEN 'function' ELSE 'method' END AS kind,
         CASE WHEN language <> 'go' THEN 'Doc' || doc_id END AS parent_symbol, start_line, end_line FROM methods
  UNION ALL
  SELECT project_id, path, language, 'Doc' || doc_id, 'class', NULL,
         CASE language WHEN 'java' THEN 8 ELSE 5 END,
         CASE language WHEN 'python' THEN last_end ELSE last_end + 1 END FROM totals WHERE language <> 'go'
  UNION ALL
  SELECT project_id, path, language, 'run' || doc_id, 'function', NULL, last_end + 2,
         CASE language WHEN 'python' THEN last_end + 3 ELSE last_end + 4 END
  FROM totals WHERE language IN ('python', 'typescript'))
"""

REFERENCES_SQL = SYMBOLS_SQL + f""",
refs AS MATERIALIZED (
  SELECT project_id, path, language, method AS from_symbol, to_name, 'call' AS kind, line,
         CASE WHEN language = 'python' THEN to_name IN ('getattr', 'setattr', 'eval', 'exec', 'globals', 'locals', 'apply')
              ELSE to_name = 'eval' END AS is_dynamic
  FROM calls WHERE CASE WHEN language = 'python' THEN simple NOT IN ({_quoted(PY_CALL_NOISE)})
                        ELSE simple NOT IN ({_quoted(BRACE_CALL_NOISE)}) END
  UNION ALL SELECT project_id, path, language, name, name, 'call', start_line, false FROM methods WHERE language = 'python'
  UNION ALL SELECT project_id, path, language, 'run' || doc_id, 'run' || doc_id, 'call', last_end + 2, false
    FROM totals WHERE language = 'python'
  UNION ALL SELECT project_id, path, language, 'run' || doc_id, 'getattr', 'call', last_end + 3, true
    FROM totals WHERE language = 'python'
  UNION ALL
  SELECT project_id, path, language, NULL, i.target, 'import', i.line, false
  FROM docs, LATERAL (SELECT unnest(CASE language
      WHEN 'java' THEN [{{'target': source_ || '.Doc' || a, 'line': 2}}, {{'target': source_ || '.Doc' || b, 'line': 3}},
                        {{'target': 'java.util.List', 'line': 4}}]
      WHEN 'python' THEN [{{'target': 'os', 'line': 1}}, {{'target': source_ || '.doc_' || a, 'line': 2}},
                          {{'target': '.doc_' || b, 'line': 3}}]
      WHEN 'typescript' THEN [{{'target': 'react', 'line': 1}}, {{'target': './doc' || a, 'line': 2}},
                              {{'target': './doc' || b, 'line': 3}}]
      ELSE [{{'target': 'fmt', 'line': 2}}] END) AS i
    FROM (SELECT project_id AS source_, abs(doc_id - 4) AS a, abs(doc_id - 80) AS b)))
"""


def _files(t: Tables) -> DataFrame:
    return code_files(t.spread("documents"))


def _index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and references from files that are read once; both are fixed once, and dealt by file."""
    found = scan_once(files)
    items = structure(found)
    return symbols_of(items), references_of(found, items)


def _symbols(files: DataFrame) -> DataFrame:
    """Symbols, fixed once: several steps of an operator may read them."""
    return stored(symbols_of(structure(scan(files))))


def _references(files: DataFrame) -> DataFrame:
    """References with the path of their file."""
    found = scan(files)
    return references_of(found, structure(found), keep=("path",))


def _chunks(files: DataFrame) -> DataFrame:
    return C.chunk_files(files, scanned=True)


@query("code_symbols", f"WITH {SYMBOLS_SQL} SELECT path, name, kind, parent_symbol, start_line::INT AS start_line, end_line::INT AS end_line FROM symbols")
def code_symbols(t: Tables) -> DataFrame:
    files = _files(t)
    return _symbols(files).join(files.select("file_id", "path"), "file_id").select(
        "path", "name", "kind", "parent_symbol", "start_line", "end_line")


@query("code_references", f"""WITH {REFERENCES_SQL}
SELECT path, from_symbol, to_name, kind, line::INT AS line, is_dynamic FROM refs""")
def code_references(t: Tables) -> DataFrame:
    return _references(_files(t)).select("path", "from_symbol", "to_name", "kind", "line", "is_dynamic")


@query("code_depth", f"""WITH {CODE_SQL}
SELECT path, (CASE language WHEN 'java' THEN 2 WHEN 'typescript' THEN 2 ELSE 1 END)::INT AS max_depth, 0::INT AS end_depth,
       (last_end + tail)::BIGINT AS n_lines
FROM totals WHERE language <> 'python'""")
def code_depth(t: Tables) -> DataFrame:
    """IDX-1 + IDX-3: depth after comments and literals are blanked."""
    lines = code_lines(lex_once(_files(t))).filter("language <> 'python'")
    return with_depth(lines).groupBy("path").agg(
        F.max("depth_after").alias("max_depth"), F.max_by("depth_after", "line_no").alias("end_depth"),
        F.count("*").alias("n_lines"))


@query("code_chunks")
def code_chunks(t: Tables) -> DataFrame:
    files = _files(t)
    return _chunks(files).select(
        "path", "start_line", "end_line", "chunk_type", "symbol", "parent_symbol", "token_count",
        F.md5("content").alias("content_md5"))


@query("code_chunk_fidelity", f"""WITH {CODE_SQL}
SELECT path, 0::BIGINT AS wrong_text, 0::BIGINT AS too_long, true AS covers_declarations FROM totals""")
def code_chunk_fidelity(t: Tables) -> DataFrame:
    """Chunk text is exactly its line range, multi-line chunks keep the limit,
    and the first and last declaration lines of a file are inside chunks."""
    from corpuscope.functions.text import line_range, split_lines

    files = _files(t)
    tasks = task_count(files)
    # a file's chunks meet its text as one row a file, so its lines are there once, not once a chunk
    chunks = _chunks(files).select("file_id", "start_line", "end_line", "content").repartition(tasks, "file_id") \
        .groupBy("file_id").agg(F.collect_list(F.struct("start_line", "end_line", "content")).alias("chunks"))
    joined = chunks.join(files.select("file_id", "path", "content").repartition(tasks, "file_id"), "file_id") \
        .select("path", "chunks", F.explode(F.array(split_lines("content"))).alias("lines"))
    wrong = F.filter("chunks", lambda c: c["content"] != line_range("lines", c["start_line"], c["end_line"]))
    long = F.filter("chunks", lambda c: (F.length(c["content"]) > 500) & (c["end_line"] > c["start_line"]))
    counted = joined.select("path", F.size(wrong).alias("wrong"), F.size(long).alias("long"), F.array_min("chunks.start_line").alias("first"),
                            F.array_max("chunks.end_line").alias("last"), F.size("lines").alias("n_lines"))
    return counted.groupBy("path").agg(
        F.sum("wrong").alias("wrong_text"), F.sum("long").alias("too_long"),
        ((F.min("first") <= 8) & (F.max("last") >= F.max("n_lines") - 4)).alias("covers_declarations"))


@query("embed_chunks")
def embed_chunks(t: Tables) -> DataFrame:
    files = _files(t)
    embedded = C.attach_embeddings(_chunks(files), dim=64)
    return embedded.select("chunk_id", F.size("embedding").alias("dim"),
                           F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm2"))


@query("symbol_lookup", f"""WITH {SYMBOLS_SQL},
req AS (SELECT doc_id AS request_id, project_id, path AS file_path FROM docs),
hits AS (SELECT r.request_id, s.path, s.start_line, s.kind, s.path = r.file_path AS inside
         FROM req r JOIN symbols s ON r.project_id = s.project_id AND lower(s.name) = 'm_the'),
w AS (SELECT *, bool_or(inside) OVER (PARTITION BY request_id) AS scoped FROM hits)
SELECT request_id, path, start_line::INT AS start_line, kind FROM w WHERE inside OR NOT scoped""")
def symbol_lookup(t: Tables) -> DataFrame:
    files = _files(t)
    requests = t.documents.select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("project_id"), F.lit(" M_THE ").alias("name"))
    paths = files.select("project_id", F.col("path").alias("file_path"),
                         F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("request_id"))
    scoped = requests.join(paths, ["request_id", "project_id"])
    return G.lookup_symbols(scoped, _symbols(files), files).select("request_id", "path", "start_line", "kind")


@query("similar_names", f"""WITH {SYMBOLS_SQL},
req AS (SELECT doc_id AS request_id, project_id, coalesce(regexp_extract(lower(text), '[a-z]+'), '') AS name FROM docs),
names AS (SELECT DISTINCT project_id, name FROM symbols),
hits AS (SELECT DISTINCT r.request_id, n.name FROM req r JOIN names n ON r.project_id = n.project_id
         AND contains(lower(n.name), r.name) WHERE r.name <> ''
         AND NOT EXISTS (SELECT 1 FROM names e WHERE e.project_id = r.project_id AND lower(e.name) = r.name))
SELECT request_id, name, position FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY name) AS position FROM hits)""")
def similar_names(t: Tables) -> DataFrame:
    requests = t.documents.select(
        F.col("doc_id").alias("request_id"), F.col("source").alias("project_id"),
        F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("name"))
    return G.similar_names(requests, _symbols(_files(t)))


def _declared(symbols: DataFrame) -> DataFrame:
    return symbols.select("project_id", F.col("name")).distinct().select(
        F.concat_ws("/", "project_id", "name").alias("request_id"), "project_id", "name")


@query("callers", f"""WITH {REFERENCES_SQL},
names AS (SELECT DISTINCT project_id, name FROM symbols),
r AS (SELECT n.project_id || '/' || n.name AS request_id, f.path, f.line, f.from_symbol, f.to_name, f.is_dynamic,
        row_number() OVER (PARTITION BY n.project_id, n.name ORDER BY f.path, f.line, f.to_name, f.from_symbol) AS position
      FROM names n JOIN refs f ON f.project_id = n.project_id AND f.kind = 'call'
       AND lower(string_split(f.to_name, '.')[-1]) = lower(n.name))
SELECT request_id, position, path, line::INT AS line, from_symbol, to_name, is_dynamic FROM r""")
def callers(t: Tables) -> DataFrame:
    """Callers of every declared name."""
    files = _files(t)
    symbols, refs = _index(files)
    return G.callers(_declared(symbols), refs, files)


CALLEES_SQL = REFERENCES_SQL + """,
counts AS (SELECT project_id, lower(name) AS k, count(*) AS n FROM symbols GROUP BY ALL),
cand AS (SELECT project_id || '/' || name AS request_id, *,
           row_number() OVER (PARTITION BY project_id, name ORDER BY path, start_line, end_line) AS candidate
         FROM symbols),
inside AS (SELECT c.request_id, c.candidate, f.to_name, f.line, f.is_dynamic, c.project_id,
             row_number() OVER (PARTITION BY c.request_id, c.candidate ORDER BY f.line, f.to_name, f.from_symbol) AS position
           FROM cand c JOIN refs f ON f.path = c.path AND f.kind = 'call' AND f.line BETWEEN c.start_line AND c.end_line),
callees AS MATERIALIZED (SELECT i.request_id, i.candidate, i.position, i.to_name, i.line::INT AS line,
  coalesce(n, 0) > 0 AS resolved, coalesce(n, 0) AS candidates, i.is_dynamic
  FROM inside i LEFT JOIN counts k ON k.project_id = i.project_id
    AND k.k = lower(string_split(i.to_name, '.')[-1]))
"""


def _candidates(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every declaration as a candidate of its name."""
    return symbols.join(files.select("file_id", "path"), "file_id").withColumn("request_id", F.concat_ws("/", "project_id", "name"))


@query("callees", f"WITH {CALLEES_SQL} SELECT * FROM callees")
def callees(t: Tables) -> DataFrame:
    """Callees of every declaration."""
    files = _files(t)
    symbols, refs = _index(files)
    return G.callees(_candidates(files, symbols), refs, symbols)


@query("symbol_notes", f"""WITH {CALLEES_SQL},
found AS (SELECT request_id, count(*) AS n_candidates FROM cand GROUP BY 1),
d AS (SELECT c.project_id || '/' || c.name AS request_id, count(*) FILTER (f.is_dynamic) AS n FROM (SELECT DISTINCT project_id, name FROM symbols) c
      JOIN refs f ON f.project_id = c.project_id AND f.kind = 'call'
      AND lower(string_split(f.to_name, '.')[-1]) = lower(c.name) GROUP BY 1),
u AS (SELECT request_id, count(*) FILTER (NOT resolved) AS n FROM callees GROUP BY 1)
SELECT f.request_id, n_candidates, coalesce(d.n, 0) AS n_dynamic, coalesce(u.n, 0) AS n_unresolved
FROM found f LEFT JOIN d USING (request_id) LEFT JOIN u USING (request_id)""")
def symbol_notes(t: Tables) -> DataFrame:
    files = _files(t)
    symbols, refs = _index(files)
    candidates = _candidates(files, symbols)
    requests = candidates.select("request_id", "project_id", "name").distinct()
    return G.honesty_notes(requests, candidates, G.callers(requests, refs, files),
                           G.callees(candidates, refs, symbols)).drop("notes")


@query("symbol_sources", f"""WITH {SYMBOLS_SQL}
SELECT path, name, start_line::INT AS start_line, end_line::INT - start_line::INT + 1 AS n_lines FROM symbols""")
def symbol_sources(t: Tables) -> DataFrame:
    """GRF-6: the whole source of every declaration, as the lines of the file hold it."""
    files = _files(t)
    sources = G.symbol_sources(_symbols(files), files)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return sources.select("path", "name", "start_line", lines.alias("n_lines"))


@query("call_edges", f"""WITH {REFERENCES_SQL},
counts AS (SELECT project_id, lower(name) AS k, count(*) AS n FROM symbols GROUP BY ALL)
SELECT f.path, count(*) AS calls, count(n) AS resolved, coalesce(sum(n), 0)::BIGINT AS candidates,
       count(*) FILTER (is_dynamic) AS dynamic_calls
FROM refs f LEFT JOIN counts c ON c.project_id = f.project_id AND c.k = lower(string_split(f.to_name, '.')[-1])
WHERE f.kind = 'call' GROUP BY f.path""")
def call_edges(t: Tables) -> DataFrame:
    """All call edges, summed per file."""
    files = _files(t)
    symbols, refs = _index(files)
    edges = G.call_edges(refs, symbols, files)
    return edges.groupBy("path").agg(
        F.count("*").alias("calls"), F.count_if("resolved").alias("resolved"),
        F.sum("candidates").alias("candidates"), F.count_if("is_dynamic").alias("dynamic_calls"))


IMPORTS_SQL = REFERENCES_SQL + """,
imports AS MATERIALIZED (
  SELECT r.project_id, r.path, r.language, r.to_name AS target, r.line::INT AS line, d.path AS resolved_path,
         (d.path IS NULL AND r.language = 'typescript' AND NOT starts_with(r.to_name, '.')) AS external
  FROM refs r LEFT JOIN docs d ON d.project_id = r.project_id AND d.path = CASE r.language
    WHEN 'java' THEN replace(r.to_name, '.', '/') || '.java'
    WHEN 'python' THEN CASE WHEN starts_with(r.to_name, '.') THEN r.project_id || '/' || substr(r.to_name, 2) || '.py'
                            ELSE replace(r.to_name, '.', '/') || '.py' END
    WHEN 'typescript' THEN r.project_id || '/' || substr(r.to_name, 3) || '.ts' END
  WHERE r.kind = 'import')
"""


@query("import_resolution", f"WITH {IMPORTS_SQL} SELECT path, target, line, resolved_path, external FROM imports")
def import_resolution(t: Tables) -> DataFrame:
    files = _files(t)
    return G.resolve_imports(_references(files).drop("path"), files).select("path", "target", "line", "resolved_path", "external")


@query("file_dependencies", f"""WITH {IMPORTS_SQL}
SELECT project_id, path, count(*) AS imports, count(*) FILTER (resolved_path IS NULL) AS unresolved,
       count(*) FILTER (external) AS external FROM imports GROUP BY ALL""")
def file_dependencies(t: Tables) -> DataFrame:
    files = _files(t)
    return G.dependency_summary(G.resolve_imports(_references(files).drop("path"), files))


@query("referenced_by", f"""WITH {REFERENCES_SQL},
names AS (SELECT DISTINCT project_id, path, lower(name) AS k FROM symbols),
calling AS (SELECT DISTINCT project_id, path, lower(string_split(to_name, '.')[-1]) AS k FROM refs WHERE kind = 'call'),
pairs AS (SELECT DISTINCT n.path, c.path AS caller_path FROM names n JOIN calling c
          ON c.project_id = n.project_id AND c.k = n.k AND c.path <> n.path),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY caller_path) AS position FROM pairs)
SELECT path, caller_path, position FROM ranked""")
def referenced_by(t: Tables) -> DataFrame:
    files = _files(t)
    symbols, refs = _index(files)
    found = G.referenced_by(files.select("project_id", "file_id"), refs, symbols, files)
    return found.join(files.select("file_id", "path"), "file_id").select("path", "caller_path", "position")


@query("symbol_listing", f"""WITH {SYMBOLS_SQL}
SELECT project_id, path, count(*) AS symbols, min(start_line)::INT AS first_line FROM symbols GROUP BY ALL""")
def symbol_listing(t: Tables) -> DataFrame:
    """GRF-1, folded to one row per file."""
    files = _files(t)
    return G.symbol_listing(_symbols(files), files).groupBy("project_id", "path").agg(
        F.count("*").alias("symbols"), F.min("start_line").alias("first_line"))


@query("code_words", f"WITH {CODE_SQL} SELECT path, sum(n_calls)::BIGINT AS words FROM methods GROUP BY path")
def code_words(t: Tables) -> DataFrame:
    """The rendering itself: words per derived file."""
    words = F.size(words_of(F.col("text")))
    per_doc = t.documents.select("doc_id", words.cast("long").alias("words"))
    paths = _files(t).select("path", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"))
    return paths.join(per_doc, "doc_id").select("path", "words")
