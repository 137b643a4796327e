"""Registered queries: hygiene, paths, text functions, reading, chunking of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import paths as PA
from corpuscope.functions import text as TX
from corpuscope.functions.languages import is_external_import, language_of, supports_symbols
from corpuscope.operators import chunking as C
from corpuscope.operators import evaluation as E
from corpuscope.operators import hygiene as H
from corpuscope.operators import reading as RD
from corpuscope.operators.lines import line_counts, text_lines
from corpuscope.operators.symbols import with_depth
from corpuscope.plans.derived import text_files
from corpuscope.plans.registry import Tables, query
from corpuscope.sources.readers import lenient_text, strict_text

EMPTY_TAIL = "CASE WHEN ends_with({0}, chr(10)) THEN 1 ELSE 0 END"
N_LINES = "(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END)::INT"

FILES_SQL = """
files AS MATERIALIZED (
  SELECT source AS project_id, doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, text AS content,
         octet_length(encode(text))::BIGINT AS size_bytes FROM documents),
lines AS MATERIALIZED (
  SELECT project_id, path, doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1)::INT AS line_no
  FROM (SELECT *, CASE WHEN content = '' THEN [] WHEN ends_with(content, chr(10))
          THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS parts
        FROM files))
"""
#: WHITESPACE of ``strip`` for DuckDB
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _files(t: Tables) -> DataFrame:
    return text_files(t.documents)


# ---- paths made from page urls ----------------------------------------------
# every page gives a path whose last part is varied by page_id, so that all
# filter rules meet whole-table data
URL_TAILS = ("", "/node_modules/x.js", "/photo.PNG", "/.env", "/config/.env.local", "/server.PEM", "/Main.java",
             "/app.py", "/view.tsx", "/build/out.ts", "/key.ts", "/a\\\\id_rsa", "/./b/../c.go", "/../../up.md")
_TAIL_SQL = "[" + ", ".join("'" + x.replace("\\\\", "\\") + "'" for x in URL_TAILS) + f"][page_id % {len(URL_TAILS)} + 1]"
PATH_SQL = f"(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || {_TAIL_SQL})"


def _page_paths(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    tails = F.array(*[F.lit(x.replace("\\\\", "\\")) for x in URL_TAILS])
    tail = F.element_at(tails, (F.col("page_id") % len(URL_TAILS) + 1).cast("int"))
    return t.pages.select("page_id", F.concat(bare, tail).alias("path"), F.length("html").cast("long").alias("size"),
                          (F.col("page_id") % 7).cast("string").alias("archive_id"))


_DIRS = "node_modules|\\.git|\\.idea|\\.vscode|target|build|dist|__pycache__"
_SUFFIXES = "|".join(s.replace(".", "\\.") for s in PA.IGNORED_SUFFIXES)
_SECRETS = ", ".join(f"'{s}'" for s in PA.SECRET_NAMES)
_SECRET_SUFFIXES = "|".join(s.replace(".", "\\.") for s in PA.SECRET_SUFFIXES)
HYGIENE_SQL = f"""
paths AS MATERIALIZED (SELECT page_id, length(html)::BIGINT AS size, (page_id % 7)::VARCHAR AS archive_id, {PATH_SQL} AS path FROM pages),
flags AS MATERIALIZED (SELECT *,
  regexp_matches(path, '(^|/)({_DIRS})/') AS ignored_dir,
  regexp_matches(lower(path), '({_SUFFIXES})$') AS ignored_suffix,
  regexp_extract(lower(path), '([^/\\\\]*)$', 1) AS base FROM paths),
judged AS MATERIALIZED (SELECT *, base IN ({_SECRETS}) OR starts_with(base, '.env.') OR regexp_matches(base, '({_SECRET_SUFFIXES})$') AS secret
  FROM flags)
"""


@query("path_hygiene", f"WITH {HYGIENE_SQL} SELECT page_id, path, ignored_dir, ignored_suffix, secret FROM judged")
def path_hygiene(t: Tables) -> DataFrame:
    """FLT-1 .. FLT-3."""
    return _page_paths(t).select(
        "page_id", "path", PA.in_ignored_directory("path").alias("ignored_dir"),
        PA.has_ignored_suffix("path").alias("ignored_suffix"), PA.is_secret_file("path").alias("secret"))


@query("kept_entries", f"""WITH {HYGIENE_SQL}
SELECT page_id, path FROM judged WHERE NOT (ignored_dir OR ignored_suffix OR secret) AND NOT ends_with(path, '/')
  AND path NOT LIKE '%/../../%up.md' OR (page_id % 14 = 13 AND len(string_split(path, '/')) > 5)""")
def kept_entries(t: Tables) -> DataFrame:
    """SRC-1 hygiene: what an archive of these paths would keep."""
    return H.keep_entries(_page_paths(t)).select("page_id", "path")


@query("path_safety", f"""WITH {HYGIENE_SQL},
p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || path WHEN 1 THEN 'C:' || path WHEN 2 THEN ' ' || replace(path, '/', chr(92)) || ' '
        WHEN 3 THEN '' ELSE path END AS path FROM paths),
n AS (SELECT page_id, path, replace(trim(path), chr(92), '/') AS raw, replace(path, chr(92), '/') AS flat FROM p)
SELECT page_id,
  CASE WHEN raw = '' OR raw = '.' THEN '' WHEN starts_with(raw, '/') OR substr(raw, 2, 1) = ':' OR list_contains(string_split(raw, '/'), '..') THEN NULL
       ELSE array_to_string(list_filter(string_split(raw, '/'), lambda s: s NOT IN ('', '.')), '/') END AS tool_path,
  CASE WHEN trim(path) = '' OR starts_with(flat, '/') OR contains(flat, ':') OR list_contains(string_split(flat, '/'), '..') THEN NULL
       ELSE flat END AS backend_path
FROM n""")
def path_safety(t: Tables) -> DataFrame:
    """FLT-5, FLT-6 on paths with absolute, drive, backslash and empty variants."""
    kind = F.col("page_id") % 5
    varied = F.when(kind == 0, F.concat(F.lit("/"), "path")).when(kind == 1, F.concat(F.lit("C:"), "path")) \
        .when(kind == 2, F.concat(F.lit(" "), F.replace("path", F.lit("/"), F.lit("\\")), F.lit(" "))) \
        .when(kind == 3, "").otherwise(F.col("path"))
    return _page_paths(t).withColumn("path", varied).select(
        "page_id", PA.safe_path("path").alias("tool_path"), PA.safe_path("path", rule="backend").alias("backend_path"))


_LANG_SQL = "CASE regexp_extract(lower(path), '\\.([^.]+)$', 1) " + " ".join(
    f"WHEN '{ext}' THEN '{lang}'" for ext, lang in __import__(
        "corpuscope.functions.languages", fromlist=["EXTENSIONS"]).EXTENSIONS.items()) + " ELSE 'unknown' END"


@query("language_detect", f"""WITH {HYGIENE_SQL}, l AS (SELECT page_id, {_LANG_SQL} AS language FROM paths)
SELECT page_id, language, language IN ('java', 'javascript', 'typescript', 'tsx', 'go', 'python') AS has_symbols FROM l""")
def language_detect(t: Tables) -> DataFrame:
    """FN-1."""
    return _page_paths(t).select("page_id", language_of("path").alias("language")).withColumn(
        "has_symbols", supports_symbols("language"))


@query("archive_limits", f"""WITH {HYGIENE_SQL},
e AS (SELECT *, NOT ends_with(path, '/') AND NOT (ignored_dir OR ignored_suffix OR secret) AS kept FROM judged),
s AS (SELECT *, kept AND NOT (path LIKE '%/../../%up.md' AND len(string_split(path, '/')) <= 5) AS stored FROM e),
g AS (SELECT archive_id, count(*) FILTER (stored) AS kept_files, coalesce(sum(size) FILTER (stored), 0)::BIGINT AS kept_bytes,
  coalesce(max(size) FILTER (kept), 0) AS largest, max(page_id) AS last_entry, max(page_id) FILTER (stored) AS last_kept FROM s GROUP BY archive_id)
SELECT archive_id, kept_files, kept_bytes, largest,
  CASE WHEN largest > 20000 THEN 'file_too_large' WHEN kept_bytes > 90000 THEN 'archive_too_large'
       WHEN kept_files > 20 OR (kept_files = 20 AND last_entry > last_kept) THEN 'too_many_files' END AS rejected FROM g""")
def archive_limits(t: Tables) -> DataFrame:
    """FLT-4 with limits that this data reaches."""
    entries = _page_paths(t).withColumn("entry_no", F.col("page_id"))
    return H.archive_verdicts(entries, max_file=20_000, max_total=90_000, max_files=20)


@query("contains_filter", f"""WITH {HYGIENE_SQL} SELECT page_id, path FROM paths WHERE contains(lower(path), '/en/')""")
def contains_filter(t: Tables) -> DataFrame:
    """FLT-9."""
    return RD.contains_filter(_page_paths(t), "path", "/EN/", limit=None).select("page_id", "path")


@query("import_classify", f"""WITH {HYGIENE_SQL}, l AS (SELECT page_id, {_LANG_SQL} AS language, path FROM paths)
SELECT page_id, language IN ('javascript', 'typescript', 'tsx') AND NOT starts_with(path, '.') AS external FROM l""")
def import_classify(t: Tables) -> DataFrame:
    """FN-20."""
    return _page_paths(t).withColumn("language", language_of("path")).select(
        "page_id", is_external_import("path", "language").alias("external"))


# ---- scalar text functions ---------------------------------------------------

@query("content_hash", "SELECT doc_id, md5(text) AS content_hash, sha256(text) AS archive_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    """FN-2, FN-3."""
    return t.documents.select("doc_id", TX.content_md5("text").alias("content_hash"),
                              TX.archive_sha256("text").alias("archive_hash"))


@query("token_estimate", "SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    """FN-6."""
    return t.documents.select("doc_id", TX.token_estimate("text").alias("tokens"))


@query("line_counts", f"SELECT doc_id, {N_LINES} AS n_lines FROM documents")
def line_counts_query(t: Tables) -> DataFrame:
    """FN-4, AGG-13."""
    return line_counts(_files(t)).select(
        F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long").alias("doc_id"), "n_lines")


@query("line_facts", f"""WITH {FILES_SQL}
SELECT path, line_no, (length(raw) - length(ltrim(raw, ' ' || chr(9))))::INT AS indent,
       substr(trim(raw, {WS}), 1, 500) AS signature FROM lines""")
def line_facts(t: Tables) -> DataFrame:
    """FN-4, FN-7, FN-8 over every line."""
    return text_lines(_files(t)).select(
        "path", "line_no", TX.indent_width("raw").alias("indent"), TX.signature("raw").alias("signature"))


@query("text_decode", "SELECT doc_id, md5(text) AS lenient_md5, md5(text) AS strict_md5 FROM documents")
def text_decode(t: Tables) -> DataFrame:
    """SRC-4 and SRC-5 read valid UTF-8 unchanged."""
    raw = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", F.md5(lenient_text(raw)).alias("lenient_md5"),
                              F.md5(strict_text(raw)).alias("strict_md5"))


@query("truncated_decode", """
SELECT doc_id, md5(text) AS lenient_md5, false AS strict_ok FROM documents""")
def truncated_decode(t: Tables) -> DataFrame:
    """SRC-4 drops a broken byte, SRC-5 turns the file into a failure (IDX-7)."""
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return t.documents.select("doc_id", F.md5(lenient_text(broken)).alias("lenient_md5"),
                              strict_text(broken).isNotNull().alias("strict_ok"))


@query("failure_class", """
SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR contains(lower(text), 'rate limit') THEN 'rate_limited'
  WHEN doc_id % 9 = 1 THEN 'context_too_large' WHEN doc_id % 9 = 2 THEN 'rate_limited'
  WHEN doc_id % 9 = 3 THEN 'context_too_large' ELSE 'other' END AS failure FROM documents""")
def failure_class(t: Tables) -> DataFrame:
    """FN-16 on messages around every document text."""
    k = F.col("doc_id") % 9
    status = F.when(k == 0, 429).when(k == 1, 413).otherwise(500)
    message = F.concat("text", F.when(k == 2, " Too Many Requests").when(k == 3, " maximum context reached").otherwise(""))
    return t.documents.select("doc_id", TX.failure_class(status, message).alias("failure"))


# ---- reading ----------------------------------------------------------------

GREP_PATTERN = "(tion|sh) (of|to|la) "


@query("grep_lines", f"""WITH {FILES_SQL},
m AS (SELECT project_id, path, line_no AS line, trim(raw, {WS}) AS text,
        row_number() OVER (PARTITION BY project_id ORDER BY path, line_no) AS position
      FROM lines WHERE regexp_matches(raw, '{GREP_PATTERN}'))
SELECT * FROM m""")
def grep_lines(t: Tables) -> DataFrame:
    """RET-9: every match of every project."""
    return RD.grep(_files(t), GREP_PATTERN)


@query("grep_summary", f"""WITH {FILES_SQL},
m AS (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path, line_no) AS position
      FROM lines WHERE regexp_matches(raw, '{GREP_PATTERN}')),
k AS (SELECT project_id, count(*) AS n FROM m GROUP BY 1)
SELECT f.project_id, count(*) AS files_scanned, coalesce(max(n), 0) AS n_matches, false AS capped, 0::BIGINT AS files_skipped
FROM files f LEFT JOIN k USING (project_id) GROUP BY f.project_id""")
def grep_summary(t: Tables) -> DataFrame:
    files = _files(t)
    return RD.grep_summary(files, RD.grep(files, GREP_PATTERN))


@query("read_range", f"""WITH {FILES_SQL},
r AS (SELECT doc_id, path, content, string_split(content, chr(10)) AS parts, (doc_id % 7 + 1)::INT AS a, (doc_id % 7 + 12)::INT AS b FROM files),
n AS (SELECT *, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS total FROM r)
SELECT doc_id AS request_id, a AS start_line, b AS end_line, total::INT AS total_lines,
  md5(CASE WHEN least(b, total) < a THEN '' ELSE array_to_string(parts[a:least(b, total)], chr(10))
      || CASE WHEN least(b, total) < len(parts) THEN chr(10) ELSE '' END END) AS content_md5
FROM n""")
def read_range(t: Tables) -> DataFrame:
    """RET-10: one range of every file."""
    files = _files(t)
    doc = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")
    requests = files.select(doc.alias("request_id"), "project_id", "path",
                            (doc % 7 + 1).cast("int").alias("start_line"), (doc % 7 + 12).cast("int").alias("end_line"))
    return RD.read_ranges(requests, files).select(
        "request_id", "start_line", "end_line", "total_lines", F.md5("content").alias("content_md5"))


@query("read_whole", f"""WITH {FILES_SQL},
r AS (SELECT doc_id, content, string_split(content, chr(10)) AS parts FROM files),
n AS (SELECT *, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS total FROM r)
SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 2 THEN 'not_found' WHEN 3 THEN 'bad_path' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 4 < 2 THEN total END::INT AS total_lines, CASE WHEN doc_id % 4 < 2 THEN md5(content) END AS content_md5 FROM n""")
def read_whole(t: Tables) -> DataFrame:
    """RET-10 without bounds: whole files, by plain and dotted paths; absent and forbidden ones are told."""
    files = _files(t)
    doc = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")
    varied = F.when(doc % 4 == 0, F.col("path")).when(doc % 4 == 1, F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("//")))) \
        .when(doc % 4 == 2, F.concat("path", F.lit(".bak"))).otherwise(F.concat(F.lit("../"), "path"))
    none = F.lit(None).cast("int")
    requests = files.select(doc.alias("request_id"), "project_id", varied.alias("path"), none.alias("start_line"), none.alias("end_line"))
    return RD.read_ranges(requests, files).select("request_id", "status", "total_lines", F.md5("content").alias("content_md5"))


@query("list_files", f"""WITH {FILES_SQL}, r AS (SELECT project_id, path, size_bytes,
  row_number() OVER (PARTITION BY project_id ORDER BY path) AS position FROM files)
SELECT project_id, path, size_bytes, position FROM r""")
def list_files(t: Tables) -> DataFrame:
    """SRC-6."""
    return RD.list_files(_files(t)).select("project_id", "path", "size_bytes", "position")


@query("read_by_path", f"""WITH {FILES_SQL},
q AS (SELECT doc_id AS request_id, project_id, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN '../' || path
        WHEN 2 THEN path || '.bak' ELSE replace(path, '/', chr(92)) END AS path FROM files)
SELECT request_id, CASE WHEN list_contains(string_split(q.path, '/'), '..') THEN 'bad_path' WHEN f.path IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
  length(f.content)::INT AS chars
FROM q LEFT JOIN files f ON f.project_id = q.project_id AND f.path = replace(q.path, chr(92), '/')""")
def read_by_path(t: Tables) -> DataFrame:
    """RET-14."""
    files = _files(t)
    doc = F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long")
    varied = F.when(doc % 4 == 0, F.col("path")).when(doc % 4 == 1, F.concat(F.lit("../"), "path")) \
        .when(doc % 4 == 2, F.concat("path", F.lit(".bak"))).otherwise(F.replace("path", F.lit("/"), F.lit("\\")))
    requests = files.select(doc.alias("request_id"), "project_id", varied.alias("path"))
    return RD.read_by_path(requests, files).select("request_id", "status", F.length("content").alias("chars"))


TREE_SQL = FILES_SQL + """,
nodes AS (SELECT project_id, path AS file, doc_id, size_bytes, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files),
tree AS MATERIALIZED (SELECT DISTINCT project_id, array_to_string(parts[1:i], '/') AS path, array_to_string(parts[1:i-1], '/') AS parent, parts[i] AS name,
  CASE WHEN i = len(parts) THEN 'file' ELSE 'directory' END AS type, CASE WHEN i = len(parts) THEN size_bytes END AS size_bytes FROM nodes)
"""


@query("file_tree", f"WITH {TREE_SQL} SELECT project_id, path, parent, name, type, size_bytes FROM tree")
def file_tree(t: Tables) -> DataFrame:
    """RET-11."""
    return RD.file_tree(_files(t)).select("project_id", "path", "parent", "name", "type", "size_bytes")


@query("tree_directories", f"WITH {TREE_SQL} SELECT project_id, path FROM tree WHERE type = 'directory'")
def tree_directories(t: Tables) -> DataFrame:
    """RET-12."""
    return RD.tree_directories(RD.file_tree(_files(t))).select("project_id", "path")


@query("tree_flatten", f"WITH {TREE_SQL} SELECT project_id, path, name FROM tree WHERE type = 'file'")
def tree_flatten(t: Tables) -> DataFrame:
    """RET-12."""
    return RD.tree_files(RD.file_tree(_files(t))).select("project_id", "path", "name")


@query("natural_sort", f"""WITH {TREE_SQL}
SELECT path, CASE WHEN type = 'directory' THEN '0' ELSE '1' END || array_to_string(list_transform(
  regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key
FROM tree""")
def natural_sort(t: Tables) -> DataFrame:
    """RET-13: the display-order key of every node."""
    return RD.folders_first(RD.file_tree(_files(t))).select("path", RD.sort_rank_key().alias("sort_key"))


@query("project_rollup", f"WITH {FILES_SQL} SELECT project_id, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_size_bytes FROM files GROUP BY 1")
def project_rollup(t: Tables) -> DataFrame:
    """AGG-14."""
    return E.project_rollup(_files(t))


@query("project_scope", f"WITH {FILES_SQL} SELECT path, size_bytes FROM files WHERE project_id = 'src7'")
def project_scope(t: Tables) -> DataFrame:
    """FLT-7."""
    return H.in_project(_files(t), "src7").select("path", "size_bytes")


@query("ready_projects", f"""WITH {FILES_SQL}
SELECT project_id, count(*) AS files FROM files WHERE (regexp_extract(project_id, '[0-9]+'))::INT % 2 = 0 GROUP BY 1""")
def ready_projects(t: Tables) -> DataFrame:
    """FLT-8: only projects in state ready."""
    files = _files(t)
    even = F.regexp_extract("project_id", "[0-9]+", 0).cast("int") % 2 == 0
    projects = files.select("project_id", F.when(even, "ready").otherwise("processing").alias("status")).distinct()
    return H.ready_only(files, projects).groupBy("project_id").agg(F.count("*").alias("files"))


# ---- chunking of texts --------------------------------------------------------

PARAGRAPH_SQL = FILES_SQL + f""",
l AS MATERIALIZED (SELECT path, project_id, line_no, raw, length(raw) AS chars, trim(raw, {WS}) = '' AS blank,
        max(line_no) OVER (PARTITION BY path) AS n FROM lines),
walk AS (
  WITH RECURSIVE w AS (
    SELECT path, line_no, 1 AS start, (line_no = n) AS cut FROM l WHERE line_no = 1
    UNION ALL
    SELECT l.path, l.line_no, s.start, l.line_no = l.n OR ((l.blank OR l.line_no - s.start + 1 >= 40) AND l.line_no > s.start)
    FROM w JOIN l ON l.path = w.path AND l.line_no = w.line_no + 1,
         LATERAL (SELECT CASE WHEN w.cut THEN w.line_no + 1 ELSE w.start END AS start) s)
  SELECT * FROM w),
para AS MATERIALIZED (SELECT path, start, line_no AS end_, row_number() OVER (PARTITION BY path ORDER BY start) AS b FROM walk WHERE cut)
"""


@query("paragraph_blocks", f"WITH {PARAGRAPH_SQL} SELECT path, start::INT AS start_line, end_::INT AS end_line FROM para")
def paragraph_blocks(t: Tables) -> DataFrame:
    """IDX-10."""
    return C.paragraph_blocks(text_files(t.spread("documents"))).select("path", F.inline("blocks")).select(
        "path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


CHUNK_SQL = PARAGRAPH_SQL + """,
sized AS MATERIALIZED (SELECT p.path, p.b, p.start, p.end_, sum(l.chars + 1)::BIGINT AS len FROM para p
  JOIN l ON l.path = p.path AND l.line_no BETWEEN p.start AND p.end_ GROUP BY ALL),
merge_ AS (
  WITH RECURSIVE m AS (
    SELECT path, b, start AS first, end_, len FROM sized WHERE b = 1
    UNION ALL
    SELECT s.path, s.b, CASE WHEN m.len + s.len + greatest(0, s.start - m.end_ - 1) <= 500 THEN m.first ELSE s.start END, s.end_,
           CASE WHEN m.len + s.len + greatest(0, s.start - m.end_ - 1) <= 500 THEN m.len + s.len + greatest(0, s.start - m.end_ - 1) ELSE s.len END
    FROM m JOIN sized s ON s.path = m.path AND s.b = m.b + 1)
  SELECT path, first, max(end_) AS last FROM m GROUP BY path, first),
total AS MATERIALIZED (SELECT path, line_no, sum(chars + 1) OVER (PARTITION BY path ORDER BY line_no) AS upto FROM l),
span AS MATERIALIZED (SELECT m.*, e.upto - coalesce(s.upto, 0) AS len, coalesce(s.upto, 0) AS base FROM merge_ m JOIN total e ON e.path = m.path AND e.line_no = m.last
  LEFT JOIN total s ON s.path = m.path AND s.line_no = m.first - 1),
big AS MATERIALIZED (SELECT * FROM span WHERE len > 500),
reach AS MATERIALIZED (SELECT b.path, b.first, b.last, a.line_no AS a, greatest(a.line_no, coalesce(max(e.line_no), 0)) AS z
  FROM big b JOIN total a ON a.path = b.path AND a.line_no BETWEEN b.first AND b.last
  LEFT JOIN total p ON p.path = b.path AND p.line_no = a.line_no - 1
  LEFT JOIN total e ON e.path = b.path AND e.line_no BETWEEN a.line_no AND b.last AND e.upto <= coalesce(p.upto, 0) + 500
  GROUP BY b.path, b.first, b.last, a.line_no),
pieces AS (
  WITH RECURSIVE p AS (
    SELECT path, first, last, a, z FROM reach WHERE a = first
    UNION ALL
    SELECT r.path, r.first, r.last, r.a, r.z FROM p JOIN reach r ON r.path = p.path AND r.first = p.first
      AND r.a = greatest(p.first, p.a + 1, p.z + 1 - 3) WHERE p.z < p.last)
  SELECT * FROM p),
ranges AS MATERIALIZED (SELECT path, first AS a, last AS z, 'module' AS chunk_type FROM span WHERE len <= 500
  UNION ALL SELECT path, a, z, 'part' FROM pieces),
texts AS (SELECT r.path, r.a, r.z, r.chunk_type, string_agg(l.raw || chr(10), '' ORDER BY l.line_no) AS content
  FROM ranges r JOIN l ON l.path = r.path AND l.line_no BETWEEN r.a AND r.z GROUP BY ALL)
"""


@query("chunk_documents", f"""WITH {CHUNK_SQL}
SELECT path, a::INT AS start_line, z::INT AS end_line, chunk_type, (length(content) // 4)::INT AS token_count, md5(content) AS content_md5
FROM texts WHERE trim(content, {WS}) <> ''""")
def chunk_documents(t: Tables) -> DataFrame:
    """IDX-10, IDX-16 .. IDX-18 over every text."""
    return C.chunk_files(text_files(t.spread("documents"))).select(
        "path", "start_line", "end_line", "chunk_type", "token_count", F.md5("content").alias("content_md5"))


@query("embedding_dimension", "SELECT len(embedding)::INT AS found_dim, count(*) AS n_chunks FROM embeddings WHERE len(embedding) <> 384 GROUP BY 1")
def embedding_dimension(t: Tables) -> DataFrame:
    """IDX-20: these vectors are not 384 wide, so all of them are reported."""
    return C.wrong_dimension(t.embeddings)


@query("page_depth", """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS code, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages),
d AS (SELECT *, length(code) - length(replace(code, '{', '')) - length(code) + length(replace(code, '}', '')) AS delta FROM l)
SELECT page_id, line_no::INT AS line_no, (sum(delta) OVER (PARTITION BY page_id ORDER BY line_no))::INT AS depth_after FROM d""")
def page_depth(t: Tables) -> DataFrame:
    """IDX-3 on raw page lines."""
    lines = t.pages.select(F.col("page_id").alias("file_id"), F.posexplode(F.split("html", "\n")).alias("pos", "code")) \
        .select("file_id", "code", (F.col("pos") + 1).alias("line_no"))
    return with_depth(lines).select(F.col("file_id").alias("page_id"), "line_no", "depth_after")


@query("page_calls", r"""SELECT page_id, len(regexp_extract_all(html, '[^A-Za-z0-9_$]track\('))::BIGINT AS track_calls,
  regexp_matches(html, '\]\s*\(') AS dynamic_line FROM pages""")
def page_calls(t: Tables) -> DataFrame:
    """IDX-12, IDX-13 on the script calls inside pages."""
    from corpuscope.functions.grammar import call_targets, is_dynamic_line

    rows = t.pages.select("page_id", F.explode(F.split("html", "\n")).alias("code"), F.lit("javascript").alias("language"))
    calls = rows.select("page_id", F.size(F.filter(call_targets(), lambda c: c == "track")).alias("n"),
                        is_dynamic_line().alias("dynamic"))
    return calls.groupBy("page_id").agg(F.sum("n").alias("track_calls"), F.bool_or("dynamic").alias("dynamic_line"))
