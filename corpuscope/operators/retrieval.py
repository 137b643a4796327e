"""Vector top-k, hydration, context and message assembly (RET-1 .. RET-8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscope import params as P
from corpuscope.functions.text import head_chars
from corpuscope.session import cut_lineage

#: similarities are compared at this precision, so copies of a vector tie
#: exactly (and break by id) whatever order the products were summed in
SIMILARITY_DIGITS = 9
#: bytes of query vectors that a task holds, and of one tile of similarities
QUERY_BLOCK_BYTES, TILE_BYTES = 32 * 1024 * 1024, 32 * 1024 * 1024

TOPK_SCHEMA = "query_id long, chunk_id long, similarity double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, as rows; a zero vector stays zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _ids(table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[name].to_numpy()


class Best:
    """The running top-k of a block of queries while chunks stream by; exact, ties by the smaller chunk id."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, tile_bytes: int = TILE_BYTES):
        self.query_ids, self.q, self.k, self.exclude_self = query_ids, q, k, exclude_self
        self.tile = max(1, tile_bytes // 8)
        self.row, self.chunk, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: no similarity below it can enter a query's list any more
        self.floor = np.full(len(q), -np.inf)

    def add(self, rows: np.ndarray, chunk_ids: np.ndarray, c: np.ndarray) -> None:
        """Chunks that the queries ``rows`` may meet, tile by tile."""
        if not len(rows) or not len(chunk_ids):
            return
        wide = min(len(chunk_ids), max(self.k, int(self.tile ** 0.5)))
        high = max(1, self.tile // wide)
        for i in range(0, len(rows), high):
            own = rows[i:i + high]
            for j in range(0, len(chunk_ids), wide):
                self._tile(own, chunk_ids[j:j + wide], c[j:j + wide])

    def _tile(self, rows, ids, c):
        scores = np.round(self.q[rows] @ c.T, SIMILARITY_DIGITS)
        if self.exclude_self:
            scores[self.query_ids[rows][:, None] == ids[None, :]] = -np.inf
        keep = min(self.k, len(ids))
        low = np.maximum(np.partition(scores, -keep, axis=1)[:, -keep], self.floor[rows])
        at, col = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))
        touched = np.isin(self.row, rows)
        row = np.concatenate((self.row[touched], rows[at]))
        chunk = np.concatenate((self.chunk[touched], ids[col]))
        score = np.concatenate((self.score[touched], scores[at, col]))
        order = np.lexsort((chunk, -score, row))
        row, chunk, score = row[order], chunk[order], score[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < self.k
        full = np.arange(len(row)) - first == self.k - 1
        self.floor[row[full]] = score[full]
        self.row, self.chunk, self.score = (np.concatenate((x[~touched], y[kept])) for x, y in ((self.row, row), (self.chunk, chunk), (self.score, score)))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[self.row], pa.int64()), pa.array(self.chunk, pa.int64()), pa.array(self.score)],
            names=["query_id", "chunk_id", "similarity"])


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """Final rank; the row_number bound becomes a group limit on both sides."""
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("chunk_id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, extra: int = 0, block_bytes: int = QUERY_BLOCK_BYTES):
    """The queries in tables of about ``block_bytes`` at most; ``extra`` bytes a query go with them."""
    sized = queries.select(F.count("*").alias("n"), F.sum(F.size("embedding") * 8 + 8 + extra).alias("bytes")).first()
    blocks = max(1, -(-(sized.bytes or 0) * 5 // (4 * block_bytes)))  # a quarter of room for an uneven hash
    if blocks > 1:
        queries = cut_lineage(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    for i in range(blocks):
        yield queries.filter(F.col("_block") == i).drop("_block").toArrow() if blocks > 1 else queries.toArrow()


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], TOPK_SCHEMA)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, exclude_self: bool = False,
                block_bytes: int = QUERY_BLOCK_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """RET-2 (and RET-1 for a single query): exact cosine top-k per query.

    ``queries(query_id, embedding[, scope])``, ``chunks(chunk_id, embedding[,
    scope])``; with a ``scope`` column a query meets the chunks of its own scope only.

    Queries go out in blocks of bounded bytes, one scan of the chunks for each; a task multiplies tiles of bounded
    bytes and carries one running top-k per query through its partition. The chunks are never shuffled, and
    a task emits k rows a query at most.
    """
    scoped = "scope" in queries.columns
    context, parts = queries.sparkSession.sparkContext, []
    wanted = chunks.select("chunk_id", "embedding", *(["scope"] if scoped else [])).filter(F.col("embedding").isNotNull())
    for block in _query_blocks(queries.select("query_id", "embedding", *(["scope"] if scoped else [])), block_bytes=block_bytes):
        if not block.num_rows:
            continue
        shared = context.broadcast((_ids(block, "query_id"), _matrix(block["embedding"]), block["scope"].to_pylist() if scoped else None))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q, scopes = shared.value
            best, of_scope = Best(query_ids, q, k, exclude_self, tile_bytes), {}
            for row, scope in enumerate(scopes or ()):
                of_scope.setdefault(scope, []).append(row)
            for batch in batches:
                ids, c = _ids(batch, "chunk_id"), _matrix(batch["embedding"])
                if scopes is None:
                    best.add(np.arange(len(q)), ids, c)
                    continue
                places: dict = {}
                for at, scope in enumerate(batch["scope"].to_pylist()):
                    if scope in of_scope and scope is not None:
                        places.setdefault(scope, []).append(at)
                for scope, at in places.items():
                    best.add(np.array(of_scope[scope]), ids[at], c[at])
            yield best.batch()

        parts.append(wanted.mapInArrow(score, TOPK_SCHEMA))
    return _ranked(_union(parts, queries.sparkSession), k)


# --------------------------------------------------------------------------
# approximate search: cells learned from the vectors, probed by each query's own need
# --------------------------------------------------------------------------

#: rows of a cell that are aimed at; training rows for each cell; rounds of k-means; the training sample's bound
CELL_ROWS, CELL_SAMPLE, CELL_ROUNDS, SAMPLE_ROWS = 64, 48, 8, 200_000
#: queries whose exact top-k sets the reach of an index
AUDIT_QUERIES = 256


def cell_count(rows: int) -> int:
    """Cells grow with the square root of the rows, from one cell for a few rows on."""
    return max(1, min(-(-rows // CELL_ROWS), int(4 * rows ** 0.5)))


def learn_cells(vectors: DataFrame, cells: int, seed: int = 17) -> np.ndarray:
    """Unit centroids by spherical k-means over a hashed sample of at most ``SAMPLE_ROWS`` vectors."""
    total = vectors.count()
    share = min(1.0, min(SAMPLE_ROWS, cells * CELL_SAMPLE) / max(1, total))
    sample = vectors.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    x = _matrix(sample.orderBy("chunk_id").limit(2 * SAMPLE_ROWS).select("embedding").toArrow()["embedding"])
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((1, max(1, x.shape[1])))
    random = np.random.default_rng(seed)
    centers = x[random.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(CELL_ROUNDS):
        own = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms == 0, 1, norms), centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step = max(1, TILE_BYTES // (8 * len(centers)))
    return np.concatenate([(x[i:i + step] @ centers.T).argmax(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def build_cells(chunks: DataFrame, folder: str, seed: int = 17) -> None:
    """RET-3 index: ``chunk_id, embedding`` written by ``cell`` (a probe list prunes whole folders), and the centroids."""
    spark = chunks.sparkSession
    vectors = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    centers = learn_cells(vectors, cell_count(vectors.count()), seed)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest(_matrix(batch["embedding"]), shared.value)
            yield pa.RecordBatch.from_arrays([batch["chunk_id"], batch["embedding"], pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "cell"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    vectors.mapInArrow(assign, f"chunk_id long, embedding {kind}, cell int").hint("rebalance", "cell") \
        .write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{folder}/centers")


def read_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    vectors = spark.read.parquet(f"{folder}/vectors")
    centers = spark.read.parquet(f"{folder}/centers").orderBy("cell").toArrow()["center"]
    return vectors, np.array(centers.to_pylist())


def audit_cells(queries: DataFrame, folder: str, k: int, exclude_self: bool = False, recall: float = 0.9) -> float:
    """Reach of an index: how far below its best centroid's similarity a query must probe so that each audited query
    finds the share ``recall`` of its exact top-k. Stored with the index, once; up to ``AUDIT_QUERIES`` queries."""
    spark = queries.sparkSession
    vectors, centers = read_cells(spark, folder)
    audited = queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT_QUERIES).toArrow()
    reach = 0.0
    if audited.num_rows:
        exact = vector_topk(spark.createDataFrame(audited), vectors, k, exclude_self)
        true = exact.join(vectors.select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").toPandas()
        near = _matrix(audited["embedding"]) @ centers.T
        gap = dict(zip(audited["query_id"].to_pylist(), near.max(axis=1, keepdims=True) - near))
        for query_id, found in true.groupby("query_id"):
            needed = np.sort(gap[query_id][found["cell"].to_numpy()])
            reach = max(reach, float(needed[int(np.ceil(recall * len(found) - 1e-9)) - 1]))
    spark.createDataFrame([(reach,)], "reach double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/reach")
    return reach


def approximate_topk(queries: DataFrame, folder: str, k: int, exclude_self: bool = False, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """RET-3: each query scores the cells whose centroid lies within the index's reach of its best one, exactly inside them.

    The number of cells is each query's own. Only folders that some query of a block probes are read.
    """
    spark = queries.sparkSession
    vectors, centers = read_cells(spark, folder)
    reach = spark.read.parquet(f"{folder}/reach").first().reach + 1e-12
    parts = []
    for block in _query_blocks(queries.select("query_id", "embedding"), extra=4 * len(centers), block_bytes=block_bytes):
        if not block.num_rows:
            continue
        q = _matrix(block["embedding"])
        near = q @ centers.T
        row, cell = np.nonzero(near >= near.max(axis=1, keepdims=True) - reach)
        order = np.argsort(cell, kind="stable")
        cell, start = np.unique(cell[order], return_index=True)
        probing = dict(zip(cell.tolist(), np.split(row[order].astype(np.int32), start[1:])))
        shared = spark.sparkContext.broadcast((_ids(block, "query_id"), q, probing))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, q, probing = shared.value
            best = Best(query_ids, q, k, exclude_self)
            for batch in batches:
                ids, c, cells = _ids(batch, "chunk_id"), _matrix(batch["embedding"]), _ids(batch, "cell")
                for code in np.unique(cells):
                    at = np.flatnonzero(cells == code)
                    best.add(probing.get(int(code), np.zeros(0, np.int32)).astype(np.int64), ids[at], c[at])
            yield best.batch()

        parts.append(vectors.filter(F.col("cell").isin(cell.tolist())).select("chunk_id", "embedding", "cell").mapInArrow(score, TOPK_SCHEMA))
    return _ranked(_union(parts, spark), k)


# --------------------------------------------------------------------------
# hydration and assembly
# --------------------------------------------------------------------------

def hydrate_results(topk: DataFrame, chunks: DataFrame, files: DataFrame,
                    preview: int = P.PREVIEW_CHARS) -> DataFrame:
    """RET-4: rows whose file is gone are dropped, after the limit."""
    return (
        topk.join(chunks, "chunk_id").join(files.select("file_id", "path"), "file_id")
        .select("query_id", "rank", "chunk_id", "file_id", F.col("path").alias("file_path"),
                head_chars("content", preview).alias("preview"), "similarity")
    )


def hydrate_context(topk: DataFrame, chunks: DataFrame, files: DataFrame,
                    max_chars: int = P.CONTEXT_CHARS) -> DataFrame:
    """RET-5: a missing file keeps its row under the path ``unknown``."""
    return (
        topk.join(chunks, "chunk_id").join(files.select("file_id", "path"), "file_id", "left")
        .select("query_id", "rank", "chunk_id",
                F.coalesce("path", F.lit("unknown")).alias("file_path"),
                "start_line", "end_line", head_chars("content", max_chars).alias("content"))
    )


def assemble_context(context: DataFrame) -> DataFrame:
    """RET-6: one text per query; a group holds the k rows of the top-k."""
    block = F.concat(
        F.lit("File: "), "file_path", F.lit("\nLines: "), F.col("start_line").cast("string"), F.lit("-"),
        F.col("end_line").cast("string"), F.lit("\nCode:\n"), "content")
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return context.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"))


def citations_json(context: DataFrame) -> DataFrame:
    """FN-19: the context rows of a query as one JSON text (k rows per group)."""
    rows = F.array_sort(F.collect_list(F.struct(
        "rank", "file_path", "start_line", "end_line", "content")))
    return context.groupBy("query_id").agg(F.to_json(rows).alias("citations"))


def assemble_messages(history: DataFrame, prompts: DataFrame, system_text: str,
                      mode: str = "reference") -> DataFrame:
    """RET-7: system row, history turns, then the prompt; ``seq`` orders them.

    ``history(conv_id, seq, role, content)``, ``prompts(conv_id, content)``.
    ``mode="reference"`` drops a system summary found in the history,
    ``mode="summary"`` keeps it.
    """
    roles = ["user", "assistant"] + (["system"] if mode == "summary" else [])
    turns = history.filter(F.col("role").isin(roles) & (F.col("content") != ""))
    return (
        prompts.select("conv_id", F.lit(-1).cast("long").alias("seq"),
                       F.lit("system").alias("role"), F.lit(system_text).alias("content"))
        .unionByName(turns.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", "content"))
        .unionByName(prompts.select("conv_id", F.lit(2 ** 62).cast("long").alias("seq"),
                                    F.lit("user").alias("role"), "content"))
    )


def ranked_files(topk: DataFrame, paths: DataFrame) -> DataFrame:
    """RET-8: first occurrence of each path, ranked again."""
    first = topk.join(paths, "chunk_id").groupBy("query_id", "path").agg(F.min("rank").alias("first_rank"))
    order = W.partitionBy("query_id").orderBy("first_rank")
    return first.withColumn("rank", F.row_number().over(order)).select("query_id", "path", "rank")
