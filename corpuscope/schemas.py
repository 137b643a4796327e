"""Table schemas of the index (ids are strings derived by hashing)."""

from pyspark.sql import types as T

_s, _i, _l, _b = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

FILES = T.StructType([
    T.StructField("project_id", _s), T.StructField("file_id", _s),
    T.StructField("path", _s), T.StructField("content", _s),
    T.StructField("content_hash", _s), T.StructField("size_bytes", _l),
    T.StructField("language", _s),
])

CHUNKS = T.StructType([
    T.StructField("project_id", _s), T.StructField("file_id", _s),
    T.StructField("chunk_id", _s), T.StructField("content", _s),
    T.StructField("start_line", _i), T.StructField("end_line", _i),
    T.StructField("chunk_type", _s), T.StructField("symbol", _s),
    T.StructField("parent_symbol", _s), T.StructField("token_count", _i),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
])

SYMBOLS = T.StructType([
    T.StructField("project_id", _s), T.StructField("file_id", _s),
    T.StructField("name", _s), T.StructField("kind", _s),
    T.StructField("parent_symbol", _s), T.StructField("start_line", _i),
    T.StructField("end_line", _i), T.StructField("signature", _s),
])

REFERENCES = T.StructType([
    T.StructField("project_id", _s), T.StructField("file_id", _s),
    T.StructField("from_symbol", _s), T.StructField("to_name", _s),
    T.StructField("kind", _s), T.StructField("line", _i),
    T.StructField("is_dynamic", _b),
])

FAILED_FILES = T.StructType([
    T.StructField("project_id", _s), T.StructField("path", _s), T.StructField("error", _s),
])

#: which version of the index counts for a project, and the upload it was made from
MANIFEST = T.StructType([
    T.StructField("project_id", _s), T.StructField("version", _s),
    T.StructField("uploaded_at", T.TimestampType()), T.StructField("archive_id", _s),
])

QUESTIONS = T.StructType([
    T.StructField("metadata", T.MapType(_s, _s)),
    T.StructField("questions", T.ArrayType(T.StructType([
        T.StructField("id", _s), T.StructField("repo", _s),
        T.StructField("question", _s), T.StructField("type", _s),
        T.StructField("expected_files", T.ArrayType(_s)),
        T.StructField("expected_line_ranges", T.ArrayType(T.ArrayType(_i))),
        T.StructField("reference_answer_points", T.ArrayType(_s)),
    ]))),
])
