"""Blocks to chunks, and embeddings (IDX-9, IDX-10, IDX-16 .. IDX-20).

Chunking is narrow: a file's line array and its block array stay in one row.
The two greedy rules (paragraph cuts, merge-then-split) depend on where the
previous piece started, which neither a window nor a prefix sum can express,
so small Arrow helpers decide them over *line lengths only*; texts never leave
the JVM and every helper is linear in the lines of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope import params as P
from corpuscope.functions import grammar as G
from corpuscope.functions.languages import SYMBOL_LANGUAGES
from corpuscope.functions.text import WHITESPACE, is_blank, let, line_range, split_lines, token_estimate
from corpuscope.operators.lines import file_tasks, lexed_files
from corpuscope.operators.scan import BATCH_CHARS, File, capable, texts

BLOCK_TYPE = "array<struct<start:int,end:int,kind:string,name:string,parent:string>>"

PIECE_SCHEMA = (
    "project_id string, file_id string, path string, seq int, content string, start_line int, end_line int, chunk_type string, "
    "symbol string, parent_symbol string"
)


def _paragraph_ends(max_lines: int):
    """IDX-10: cut after a blank line or at ``max_lines``, never a lone line."""

    @F.pandas_udf("array<int>")
    def ends(blanks: pd.Series) -> pd.Series:
        def cut(flags):
            out, start, total = [], 1, len(flags)
            for line, blank in enumerate(flags, 1):
                if line == total or ((blank or line - start + 1 >= max_lines) and line > start):
                    out.append(line)
                    start = line + 1
            return out

        return blanks.map(cut)

    return ends


def paragraph_blocks(files: DataFrame, max_lines: int = P.PARAGRAPH_MAX_LINES) -> DataFrame:
    """Files without a symbol grammar: ``lines`` and paragraph ``blocks``."""
    ends = _paragraph_ends(max_lines)
    return (
        files.select("project_id", "file_id", "path", "language", split_lines("content").alias("lines"))
        .withColumn("ends", ends(F.transform("lines", is_blank)))
        .withColumn("ranges", F.arrays_zip(
            F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", F.lit(1), F.greatest(
                F.size("ends") - 1, F.lit(0))), lambda e: e + 1)).alias("start"),
            F.col("ends").alias("end")))
        .select(
            "project_id", "file_id", "path", "language", "lines",
            F.transform(F.filter("ranges", lambda r: r["end"].isNotNull()), lambda r: F.struct(
                r["start"].alias("start"), r["end"].alias("end"),
                F.lit("module").alias("kind"),
                F.lit(None).cast("string").alias("name"),
                F.lit(None).cast("string").alias("parent"))).cast(BLOCK_TYPE).alias("blocks"),
        )
    )


def structural_blocks(files: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Symbol-capable files: ``lines`` and declaration + gap ``blocks`` (IDX-9).

    A gap without meaning is dropped; one outside any container is ``imports``
    when all of its lines are blank, comment headers or imports.
    """
    tasks = file_tasks(files)  # both sides of the join are dealt alike
    lexed = lexed_files(files, strict, tasks).withColumn("pairs", F.arrays_zip("raw", "code"))
    per_file = (
        items.filter(F.col("item").isin("block", "gap"))
        .repartition(*tasks, "file_id")
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("start_line").alias("start"), F.col("end_line").alias("end"),
            (F.col("item") == "gap").alias("gap"), "kind", "name",
            F.col("parent_symbol").alias("parent")))).alias("found"))
    )
    # a file without any declaration is one gap
    whole = F.array(F.struct(
        F.lit(1).alias("start"), F.size("raw").alias("end"), F.lit(True).alias("gap"),
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("parent")))

    # the patterns only run over lines of gaps
    def gap_lines(block, test) -> Column:
        return F.transform(
            F.slice("pairs", block["start"], block["end"] - block["start"] + 1),
            lambda line: test(line["raw"], F.coalesce(line["code"], F.lit(""))))

    def keep(block) -> Column:
        meaning = gap_lines(block, lambda raw, code: G.has_meaning(code, F.col("language")))
        return ~block["gap"] | F.exists(meaning, lambda m: m)

    def finish(block) -> Column:
        loose = block["gap"] & block["name"].isNull()
        imports = gap_lines(block, lambda raw, code: G.is_import_like(raw, code, F.col("language")))
        kind = F.when(loose & F.forall(imports, lambda m: m), "imports") \
            .when(loose, "module").otherwise(block["kind"])
        return F.struct(block["start"].alias("start"), block["end"].alias("end"), kind.alias("kind"),
                        block["name"].alias("name"), block["parent"].alias("parent"))

    return (
        lexed.join(per_file, "file_id", "left")
        .filter(F.size("raw") > 0)
        .withColumn("found", F.coalesce("found", whole))
        .select("project_id", "file_id", "path", "language", F.col("raw").alias("lines"),
                F.transform(F.filter("found", keep), finish).cast(BLOCK_TYPE).alias("blocks"))
    )


def _merge_blocks(lengths, starts, ends, named, max_chars, min_chars):
    """IDX-16: greedy runs of blocks as (first, last) positions."""
    first, size = 0, lengths[0]
    for i in range(1, len(lengths)):
        joined = size + lengths[i] + max(0, starts[i] - ends[i - 1] - 1)
        shells = not named[i] and not named[i - 1]
        tiny = lengths[i] < min_chars and size < min_chars
        if joined <= max_chars and (shells or tiny):
            size = joined
        else:
            yield first, i - 1
            first, size = i, lengths[i]
    yield first, len(lengths) - 1


def _split_range(total, start, end, max_chars, overlap):
    """IDX-17: pieces of whole lines; ``total`` are running characters."""
    piece = start
    while True:
        # last line that still fits; a longer line stands alone
        last = int(np.searchsorted(total, total[piece - 1] + max_chars, side="right")) - 1
        last = min(max(last, piece), end)
        yield piece, last
        if last >= end:
            return
        piece = max(start, piece + 1, last + 1 - overlap)


def _planner(max_chars: int, min_chars: int, overlap: int):
    max_chars = max(P.CHUNK_MAX_CHARS_FLOOR, max_chars)
    min_chars = max(1, min(min_chars, max_chars))
    overlap = max(0, overlap)

    @F.pandas_udf("array<struct<first:int,last:int,start:int,end:int,part:boolean>>")
    def plan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for line_lengths, starts, ends, named in batches:
            yield pd.Series([
                _plan_file(n, s, e, k, max_chars, min_chars, overlap)
                for n, s, e, k in zip(line_lengths, starts, ends, named)])

    return plan


def _plan_file(line_lengths, starts, ends, named, max_chars, min_chars, overlap):
    if len(starts) == 0:
        return []
    total = np.concatenate([[0], np.cumsum(np.asarray(line_lengths, dtype=np.int64) + 1)])
    starts, ends = np.asarray(starts), np.asarray(ends)
    lengths = (total[ends] - total[starts - 1]).tolist()
    starts, ends = starts.tolist(), ends.tolist()
    out: list[tuple] = []
    for first, last in _merge_blocks(lengths, starts, ends, list(named), max_chars, min_chars):
        start, end = starts[first], ends[last]
        if total[end] - total[start - 1] <= max_chars:
            out.append((first + 1, last + 1, start, end, False))
        else:
            out.extend((first + 1, last + 1, a, b, True)
                       for a, b in _split_range(total, start, end, max_chars, overlap))
    return out


def chunks_from_blocks(
    blocked: DataFrame,
    max_chars: int = P.CHUNK_MAX_CHARS,
    min_chars: int = P.CHUNK_MIN_CHARS,
    overlap_lines: int = P.CHUNK_OVERLAP_LINES,
) -> DataFrame:
    """IDX-18: the ``chunks`` table (without vectors); blank chunks dropped."""
    plan = _planner(max_chars, min_chars, overlap_lines)
    planned = blocked.withColumn("plan", plan(
        F.transform("lines", F.length),
        F.transform("blocks", lambda b: b["start"]),
        F.transform("blocks", lambda b: b["end"]),
        F.transform("blocks", lambda b: b["name"].isNotNull())))

    def describe(piece, group) -> Column:
        kinds = F.array_distinct(F.transform(group, lambda b: b["kind"]))
        named = F.get(F.filter(group, lambda b: b["name"].isNotNull()), F.lit(0))
        kind = F.when(piece["part"], "part").otherwise(
            let(kinds, lambda k: F.when(F.size(k) == 1, k[0]).otherwise("module")))
        return let(named, lambda n: F.struct(
            piece["start"].alias("start_line"), piece["end"].alias("end_line"),
            kind.alias("chunk_type"), n["name"].alias("symbol"), n["parent"].alias("parent_symbol"),
            line_range("lines", piece["start"], piece["end"]).alias("content")))

    def chunk(piece) -> Column:
        group = F.slice("blocks", piece["first"], piece["last"] - piece["first"] + 1)
        return let(group, lambda g: describe(piece, g))

    return (
        planned.select("project_id", "file_id", "path",
                       F.posexplode_outer(F.transform("plan", chunk)).alias("seq", "chunk"))
        .filter(F.col("chunk").isNotNull() & ~is_blank("chunk.content"))
        .select(
            "project_id", "file_id", "path",
            F.sha2(F.concat_ws(":", "file_id", F.col("seq").cast("string")), 256).alias("chunk_id"),
            "chunk.content", "chunk.start_line", "chunk.end_line", "chunk.chunk_type",
            "chunk.symbol", "chunk.parent_symbol",
            token_estimate("chunk.content").alias("token_count"))
    )


def _chunker(strict: bool, max_chars: int, min_chars: int, overlap: int):
    max_chars = max(P.CHUNK_MAX_CHARS_FLOOR, max_chars)
    min_chars = max(1, min(min_chars, max_chars))
    overlap = max(0, overlap)
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in PIECE_SCHEMA.split(", "))])

    def pieces(file: File) -> Iterator[tuple]:
        blocks = file.blocks()
        plan = _plan_file([len(line) for line in file.raw], [b["start"] for b in blocks], [b["end"] for b in blocks],
                          [b["name"] is not None for b in blocks], max_chars, min_chars, overlap)
        for seq, (first, last, start, end, part) in enumerate(plan):
            content = "\n".join(file.raw[start - 1:end]) + "\n"
            if content.strip(WHITESPACE):
                group = blocks[first - 1:last]
                kinds = {b["kind"] for b in group}
                named = next((b for b in group if b["name"] is not None), {})
                yield (seq, content, start, end, "part" if part else kinds.pop() if len(kinds) == 1 else "module", named.get("name"), named.get("parent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = [], 0
        for (project, file_id, path, language), content in texts(batches):
            for piece in pieces(File(content, language, strict)):
                rows.append((project, file_id, path, *piece))
                seen += len(piece[1])
                if seen >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, seen = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def scanned_chunks(files: DataFrame, strict: bool = False, max_chars: int = P.CHUNK_MAX_CHARS, min_chars: int = P.CHUNK_MIN_CHARS,
                   overlap_lines: int = P.CHUNK_OVERLAP_LINES) -> DataFrame:
    """IDX-9, IDX-16 .. IDX-18 of the symbol-capable files where their text is read: blocks are found, merged, split and cut out in one pass."""
    return capable(files).mapInArrow(_chunker(strict, max_chars, min_chars, overlap_lines), PIECE_SCHEMA).select(
        "project_id", "file_id", "path", F.sha2(F.concat_ws(":", "file_id", F.col("seq").cast("string")), 256).alias("chunk_id"),
        "content", "start_line", "end_line", "chunk_type", "symbol", "parent_symbol", token_estimate("content").alias("token_count"))


def chunk_files(files: DataFrame, items: DataFrame | None = None, strict: bool = False, lexed: DataFrame | None = None,
                scanned: bool = False, **sizes) -> DataFrame:
    """Chunks of all files: structural where the language allows (by ``items``, with ``lexed`` those files, lexed before; or ``scanned``
    in one pass), else paragraphs."""
    capable_ = F.col("language").isin(*SYMBOL_LANGUAGES)
    chunks = chunks_from_blocks(paragraph_blocks(files.filter(~capable_)), **sizes)
    if scanned:
        chunks = chunks.unionByName(scanned_chunks(files, strict, **sizes))
    elif items is not None:
        chunks = chunks.unionByName(chunks_from_blocks(structural_blocks(files if lexed is None else lexed, items, strict), **sizes))
    return chunks


# --------------------------------------------------------------------------
# embeddings
# --------------------------------------------------------------------------

def hashing_model(dim: int = P.EMBED_DIM):
    """Default offline model: hashed words and word pairs, unit length."""

    def make_predict():
        import re
        from zlib import crc32

        word = re.compile(rb"[A-Za-z0-9_]+")

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                words = word.findall((text or "").lower().encode())
                single = list(map(crc32, words))
                # a pair's checksum goes on from its first word's
                pairs = map(crc32, [b" " + w for w in words[1:]], single)
                codes = np.array([*single, *pairs], dtype=np.int64)
                out[row] = np.bincount(codes % dim, weights=np.where(codes & 0x80000000, 1.0, -1.0), minlength=dim)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return predict

    return make_predict


def attach_embeddings(chunks: DataFrame, make_model=None, dim: int = P.EMBED_DIM,
                      batch_size: int = P.EMBED_BATCH) -> DataFrame:
    """IDX-19: batched model calls, one vector per chunk, aligned by row."""
    # imported here: Python workers load this module for the planner alone
    from pyspark.ml.functions import predict_batch_udf

    embed = predict_batch_udf(
        make_model or hashing_model(dim),
        return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return chunks.withColumn("embedding", embed("content"))


def wrong_dimension(chunks: DataFrame, dim: int = P.EMBED_DIM) -> DataFrame:
    """IDX-20: offending vectors per length; must be empty."""
    return (
        chunks.filter(F.col("embedding").isNull() | (F.size("embedding") != dim))
        .groupBy(F.size("embedding").alias("found_dim")).agg(F.count("*").alias("n_chunks"))
    )
