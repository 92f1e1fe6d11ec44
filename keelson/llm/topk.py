"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(64 * x), in blocks of as narrow numbers as hold them, written once. Queries meet all rows
on a grid of tasks: query blocks are dealt to its rows, candidate blocks to its columns, and the task of a cell scores
its queries against its candidates, a matrix product for each pair of blocks. A query block travels once for each
column, a candidate block once for each row, and the grid has as few rows as the queries that a task can hold allow
(HELD). Nothing is kept of the scores; each pass computes them anew and sends on a histogram per query:

1. Every query starts with the range that its scores must lie in. A pass cuts the range into BUCKETS and counts; a
   task sends a bucket only if fewer than k of its own scores lie above it, as no other can hold the kth value.
   Summed over tasks, the counts say which bucket holds the kth highest score, and that is the next range. Passes end
   when the ranges are single scores: log(range) / log(BUCKETS) passes, for any number of rows.
2. The last pass sends the scores above the kth value (fewer than k for each query) and of those equal to it the
   smallest ids, as many as are still needed. A rank by (score, vec_id) of that short list is the result. Ties, even
   of a third of all rows, never leave a task.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, as query or candidate;
vectors of different lengths aren't compared; of rows that share an id each is a query and a candidate of its own, and
only the query's own row isn't its candidate; a null vec_id takes no part; a query with fewer than k candidates returns
all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.common import materialise, release, table
from keelson.llm.packets import batches_of, numbers, rows_of

SCALE = 64
BUCKETS = 256
QUERIES = 512  # in a block
ROWS = 2048  # of candidates in a block
#: Queries that a task holds, with a histogram of 4 * BUCKETS bytes each.
HELD = 1 << 16


def integers(df: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, asked and v (array of long) of the rows that take part."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), whole.alias("v"))


BLOCK = "block long, dim int, n int, wide boolean, ids binary, asked binary, data binary, biggest long, queries int"
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, asked, v) to blocks: matrices of at most ROWS rows of one length; a row is known by block and place."""

    def each() -> Iterator[tuple]:
        held: dict[int, tuple[list, list, list]] = {}
        made = TaskContext.get().partitionId() << 24

        def out(dim: int) -> tuple:
            nonlocal made
            ids, asked, data = held.pop(dim)
            cells = np.concatenate(data) if dim else np.empty(0, np.int64)
            biggest = int(np.abs(cells).max(initial=0))
            made += 1
            return made - 1, dim, len(ids), biggest >= 1 << 15, np.array(ids, "<i8").tobytes(), np.array(asked, np.uint8).tobytes(), cells.astype("<i8" if biggest >= 1 << 15 else "<i2").tobytes(), biggest, sum(asked)

        for batch in batches:
            for vec, asked, v in zip(batch.column("vec_id").to_pylist(), batch.column("asked").to_pylist(), batch.column("v"), strict=True):
                dim = len(v)
                ids, flags, data = held.setdefault(dim, ([], [], []))
                ids.append(vec)
                flags.append(asked)
                data.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == ROWS:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    yield from batches_of(each(), [f.split()[0] for f in BLOCK.split(", ")], BLOCK_TYPES)


def matrix(data, dim: int, n: int, wide: bool) -> np.ndarray:
    return numbers(data, "<i8" if wide else "<i2").reshape(n, dim)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats where those are exact."""
    bound = int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(c.astype(np.int64)).max(initial=0)) * max(1, q.shape[1])
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < exact:
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


QUERY_BLOCK = "block long, dim int, n int, wide boolean, ids binary, rows binary, data binary, low binary, width binary"
QUERY_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]


def query_blocks(biggest: int) -> Callable:
    """The rows of blocks that are queries, in blocks of their own, with the range that their scores lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            made = TaskContext.get().partitionId() << 24
            held: dict[tuple[int, bool], list] = {}

            def out(key: tuple[int, bool]) -> Iterator[tuple]:
                nonlocal made
                ids, rows, v = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
                for i in range(0, len(ids), QUERIES):
                    part = v[i : i + QUERIES]
                    spread = np.abs(part.astype(np.int64)).sum(axis=1) * biggest
                    width = np.maximum(1, -(-(2 * spread + 1) // BUCKETS))
                    yield made, key[0], len(part), key[1], ids[i : i + QUERIES].tobytes(), rows[i : i + QUERIES].tobytes(), part.tobytes(), (-spread).tobytes(), width.tobytes()
                    made += 1

            names = [f.split()[0] for f in BLOCK.split(", ")]
            for block, dim, n, wide, ids, asked, data, *_ in rows_of(batches, names):
                at = np.nonzero(numbers(asked, np.uint8))[0]
                if len(at):
                    own = held.setdefault((dim, wide), [])
                    own.append((numbers(ids)[at], block * ROWS + at, matrix(data, dim, n, wide)[at]))
                    if sum(len(x[0]) for x in own) >= 8 * QUERIES:
                        yield from out((dim, wide))
            for key in list(held):
                yield from out(key)

        yield from batches_of(each(), [f.split()[0] for f in QUERY_BLOCK.split(", ")], QUERY_TYPES)

    return run


CELL = ["kind", "block", "dim", "n", "wide", "ids", "rows", "data", "low", "width"]


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query block, query ids, low, width, candidate ids, scores, and where queries meet themselves) of each pair of blocks
    of one length in a cell; the query blocks come first, and candidate blocks pass by."""
    held: dict[int, list[tuple]] = {}
    for kind, block, dim, n, wide, ids, rows, data, low, width in rows_of(batches, CELL):
        if kind == 0:
            held.setdefault(dim, []).append((block, numbers(ids), numbers(rows), matrix(data, dim, n, wide), numbers(low), numbers(width)))
            continue
        c, c_ids, first = matrix(data, dim, n, wide), numbers(ids), block * ROWS
        for q_block, q_ids, q_rows, q, low_, width_ in held.get(dim, ()):
            s = scores(q, c)
            own = np.nonzero((q_rows >= first) & (q_rows < first + n))[0]
            yield q_block, q_ids, low_, width_, c_ids, s, own, q_rows[own] - first


def histograms(k: int) -> Callable:
    """The counts that may matter, of each query of each block: (q, bucket, n); q is block * QUERIES + place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for block, q_ids, low, width, _, s, own, at_own in each_pair(batches):
            count = sums.setdefault(block, np.zeros((len(q_ids), BUCKETS + 1), np.int32))
            # the last column holds what lies above the range
            at = np.minimum((s - low[:, None]) // width[:, None], BUCKETS)
            at[own, at_own] = -1
            cells = at + np.arange(len(q_ids))[:, None] * (BUCKETS + 1)
            count += np.bincount(cells[at >= 0], minlength=count.size).reshape(count.shape).astype(np.int32)
        for block, count in sums.items():
            above = np.cumsum(count[:, ::-1], axis=1, dtype=np.int64)[:, ::-1] - count
            rows, columns = np.nonzero((count > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(block * QUERIES + rows), pa.array(columns.astype(np.int64)), pa.array(count[rows, columns].astype(np.int64))], names=["q", "bucket", "n"])

    return run


def winners(k: int) -> Callable:
    """Scores above the kth value, and of those equal to it the k smallest ids of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, dict[int, np.ndarray]] = {}
        levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out(block: int, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(block * QUERIES + rows), pa.array(ids), pa.array(s)], names=["query_id", "q", "vec_id", "score"])

        for block, q_ids, low, _, c_ids, s, own, at_own in each_pair(batches):
            s[own, at_own] = np.iinfo(np.int64).min
            rows, columns = np.nonzero(s > low[:, None])
            if len(rows):
                yield out(block, q_ids, rows, c_ids[columns], s[rows, columns])
            levels[block] = (q_ids, low)
            kept = ties.setdefault(block, {})
            equal = s == low[:, None]
            for i in np.nonzero(equal.any(axis=1))[0].tolist():
                ids = c_ids[equal[i]]
                if i in kept:
                    ids = np.concatenate((kept[i], ids))
                kept[i] = np.sort(ids)[:k]
        for block, kept in ties.items():
            q_ids, low = levels[block]
            for i, ids in kept.items():
                yield out(block, q_ids, np.full(len(ids), i), ids, np.full(len(ids), low[i]))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest scores of each query."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = materialise(integers(vectors, is_query, id_col, vector_col, scale).mapInArrow(blocks, BLOCK), "candidate-blocks")
    size = candidates.agg(F.max("biggest").alias("biggest"), F.sum("n").alias("n"), F.sum("queries").alias("queries"), F.count("*").alias("blocks")).first()
    if not size["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    state = materialise(candidates.where("queries > 0").mapInArrow(query_blocks(size["biggest"]), QUERY_BLOCK), "query-blocks")
    # the grid: as many cells as partitions, a query block travelling as far as a candidate block does
    rows = max(-(-size["queries"] // HELD), round(math.sqrt(n * size["queries"] / size["n"])), 1)
    columns = max(1, min(-(-n // rows), size["blocks"]))
    # a candidate block goes to the cells of its column
    null = F.lit(None).cast("binary")
    down = candidates.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cell = F.col("row") * columns + F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")
    dealt = down.select(cell.alias("cell"), F.lit(1).alias("kind"), "block", "dim", "n", "wide", "ids", null.alias("rows"), "data", null.alias("low"), null.alias("width"))

    def cells(state: DataFrame) -> DataFrame:
        across = state.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        cell = F.pmod(F.xxhash64("block"), F.lit(rows)).cast("int") * columns + F.col("column")
        asked = across.select(cell.alias("cell"), F.lit(0).alias("kind"), "block", "dim", "n", "wide", "ids", "rows", "data", "low", "width")
        return asked.union(dealt).repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("kind").select(*CELL)

    for _ in range(math.ceil(math.log(max(2, 2 * size["biggest"] * size["biggest"] * 1e6), BUCKETS)) + 8):
        found = cells(state).mapInArrow(histograms(k), "q long, bucket long, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))
        down_ = Window.partitionBy("q").orderBy(F.desc("bucket"))  # at most BUCKETS rows
        above = found.withColumn("upto", F.sum("n").over(down_))
        # the first bucket from above that reaches k; if none does, all candidates are wanted
        hit = above.where(F.col("upto") >= k).groupBy("q").agg(F.max("bucket").alias("bucket"))
        place = F.struct(F.pmod("q", F.lit(QUERIES)).alias("i"), "bucket")
        hits = hit.groupBy(F.expr(f"q div {QUERIES}").alias("block")).agg(F.collect_list(place).alias("hits"))  # at most QUERIES of a block
        both = state.join(hits, "block", "left").select("block", "dim", "n", "wide", "ids", "rows", "data", "low", "width", "hits")
        spent, state = state, materialise(both.mapInArrow(narrowed, QUERY_BLOCK + ", widest long"), "query-blocks")
        widest = state.agg(F.max("widest")).first()[0]
        release(spent)
        state = state.drop("widest")
        if widest == 0:
            break
    listed = cells(state).mapInArrow(winners(k), "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the buckets that hold their kth scores to query blocks with those as ranges; widest is 0 once all
    ranges were single scores."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                low, width = np.frombuffer(row["low"], np.int64).copy(), np.frombuffer(row["width"], np.int64).copy()
                settled = width == 1
                hits = row["hits"] or []
                at, bucket = np.array([h["i"] for h in hits], np.int64), np.array([h["bucket"] for h in hits], np.int64)
                missed = np.ones(len(low), bool)
                missed[at] = False
                low[at] += bucket * width[at]
                low[missed] -= 1  # fewer than k candidates: all are wanted
                width[at] = np.maximum(1, -(-width[at] // BUCKETS))
                width[missed] = 1
                yield (*(row[c] for c in ("block", "dim", "n", "wide", "ids", "rows", "data")), low.tobytes(), width.tobytes(), int((~settled).sum()))

    yield from batches_of(each(), [f.split()[0] for f in (QUERY_BLOCK + ", widest long").split(", ")], [*QUERY_TYPES, pa.int64()])


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
