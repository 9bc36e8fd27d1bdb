"""Nearest neighbours by inner product: a block matrix join over int8 product tiles.

Vectors are quantised to int8 with a scale per vector. What quantising loses is known per vector, so an int8 product
bounds the true one from both sides. In a tile (a block of queries times a block of candidates) one matrix product
gives all bounds; pairs whose upper bound reaches the k-th largest lower bound survive, are computed again from the
original floats in double precision, and heaps merge each query's tiles. Nothing within a tile's bounds is lost, so
the result is exact.

Blocks are dealt to the cells of a grid, query blocks to its rows and candidate blocks to its columns, and meet by a
join on the cell; so a query block is sent to one cell in 64 candidate blocks, a candidate block to one in 16 query
blocks. A task holds one tile and the heaps of one cell, whose sides don't grow with the table; what the cells of a
query found is ranked by Spark, which keeps the k best before it shuffles as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q

#: Rows of a block of queries and of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: A block of long vectors has fewer rows.
BLOCK_BYTES = 4 << 20
#: Blocks of queries and of candidates that meet in one cell of the grid, on average.
CELL = 16, 64
_BLOCK = "block long, dim int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and with one at least that isn't zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def blocks_of(rows: DataFrame, size: int, dtype: type) -> DataFrame:
    """Rows ``id, vector`` as blocks of ``size`` vectors of one length, as they lie in the tasks: nothing is shuffled."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            parts = waiting.pop(dim)
            ids, vectors = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            return pd.DataFrame({"block": [0], "dim": [dim], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

        for batch in batches:
            for dim, group in batch.groupby(batch["vector"].map(len)):
                ids, vectors = group["id"].to_numpy(np.int64), np.stack(group["vector"].to_list()).astype(dtype)
                most = max(1, min(size, BLOCK_BYTES // (dim * vectors.itemsize)))
                for at in range(0, len(ids), most):
                    waiting.setdefault(dim, []).append((ids[at : at + most], vectors[at : at + most]))
                    if sum(len(p[0]) for p in waiting[dim]) >= most:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    return rows.mapInPandas(cut, _BLOCK)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, length of the quantised vector and length of what quantising lost, per row."""
    scale = np.abs(vectors).max(1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    return codes, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(vectors - kept, axis=1)


def first_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places, ascending, of the ``most`` smallest different ids of each distinct vector: no more of equal ones can be asked for."""
    order = np.argsort(ids, kind="stable")
    keys = np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_groups = group[by_group]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_groups)) + 1]
    places = order[by_group]
    again = np.r_[False, (np.diff(sorted_groups) == 0) & (np.diff(ids[places]) == 0)]
    seen = np.cumsum(~again)
    rank = seen - np.repeat(seen[starts], np.diff(np.r_[starts, len(group)]))
    return np.sort(places[(rank < most) & ~again])


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in the tile: places of queries, candidate ids, exact scores."""
    with_self = k + 1
    left, left_scale, left_norm, left_lost = quantised(queries)
    right, right_scale, right_norm, right_lost = quantised(vectors)
    # Sums of int8 products stay below 2**24 up to a thousand components, so single precision holds them exactly;
    # beyond that its rounding is within the slack.
    products = (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.float64)
    products *= left_scale[:, None]
    products *= right_scale
    # <x, y> = <x', y'> + <x', dy> + <dx, y' + dy>, each of the last two within a product of lengths.
    slack = left_norm[:, None] * right_lost + left_lost[:, None] * (right_norm + right_lost)
    slack += 1e-6 * (left_norm + left_lost)[:, None] * (right_norm + right_lost)
    n = len(ids)
    own = query_ids[:, None] == ids
    lower = products - slack
    lower[own] = -np.inf
    at = max(0, n - with_self)
    floor = np.partition(lower, at, axis=1)[:, at] if n > with_self else np.full(len(queries), -np.inf)
    rows, places = np.nonzero((products + slack >= floor[:, None]) & ~own)
    scores = np.empty(len(rows))
    for a in range(0, len(rows), 100_000):
        part = slice(a, a + 100_000)
        scores[part] = (queries[rows[part]] * vectors[places[part]]).sum(1)
    order = np.lexsort((ids[places], -scores, rows))
    rows, places, scores = rows[order], places[order], scores[order]
    starts = np.searchsorted(rows, np.arange(len(queries)))
    best = np.arange(len(rows)) - starts[rows] < k
    return rows[best], ids[places[best]], scores[best]


def grid(queries: int, candidates: int, cores: int) -> tuple[int, int]:
    """Rows and columns of cells, from the numbers of blocks: cells of bounded sides, and enough of them for all cores."""
    high = max(1, -(-queries // CELL[0]))
    return high, max(1, -(-candidates // CELL[1]), min(candidates, -(-2 * cores // high)))


def emptied(heaps: dict[int, list[tuple[float, int]]]) -> pd.DataFrame:
    rows = [(query, -vec, score) for query, heap in heaps.items() for score, vec in heap]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row where ``queries`` holds, the k other rows of largest inner product.

    Nearest first, ties to the smaller id; all candidates, if there are fewer.

    Defined cases: rows of a null id, and vectors that are null, empty, zero, or hold a null or non-finite component
    take no part; vectors of different lengths are never compared; rows of the query's own id are not its candidates;
    rows that repeat id and vector count once; without a query the result is empty.
    """
    rows = in_small_batches(df).select(q(id_col).cast("long").alias("id"), q(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", "vector", "asks")
    dtype = np.float32 if rows.schema["vector"].dataType.elementType == T.FloatType() else np.float64
    asked = written(blocks_of(rows.where("asks").select("id", "vector"), QUERY_BLOCK, dtype).withColumn("block", F.monotonically_increasing_id()))
    stored = written(blocks_of(rows.select("id", "vector"), CANDIDATE_BLOCK, dtype).withColumn("block", F.monotonically_increasing_id()))
    # Cells of a grid: each query block goes to the cells of its row, each candidate block to those of its column.
    high, wide = grid(asked.count(), stored.count(), df.sparkSession.sparkContext.defaultParallelism)
    at = F.shiftright("block", 33) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1)) * 7919
    left = asked.select("dim", F.pmod(at, F.lit(high)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("col"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    right = stored.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("row"), F.pmod(at, F.lit(wide)).cast("int").alias("col"), "ids", "vectors")
    # Spark buffers the side that is named second: the smaller one, 16 query blocks.
    tiles = right.join(left.hint("merge"), ["dim", "row", "col"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, heaps = None, {}
        for batch in batches:
            for r in batch.itertuples():
                if (r.dim, r.row, r.col) != cell:  # a merge join gives all tiles of a cell one after the other
                    if heaps:
                        yield emptied(heaps)
                    cell, heaps = (r.dim, r.row, r.col), {}
                query_ids, ids = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.ids, np.int64)
                queries, vectors = (np.frombuffer(x, dtype).reshape(-1, r.dim).astype(np.float64) for x in (r.queries, r.vectors))
                keep = first_copies(ids, vectors, k + 1)
                at, found, scores = tile(query_ids, queries, ids[keep], vectors[keep], k)
                for query, vec, score in zip(query_ids[at].tolist(), found.tolist(), scores.tolist(), strict=True):
                    heap, one = heaps.setdefault(query, []), (score, -vec)
                    if len(heap) < k:
                        if one not in heap:
                            heapq.heappush(heap, one)
                    elif one > heap[0] and one not in heap:
                        heapq.heapreplace(heap, one)
        if heaps:
            yield emptied(heaps)
        give_back()

    found = tiles.mapInPandas(best, "query_id long, vec_id long, score double")
    # Spark keeps the k best of each query before it shuffles, and again after. Copies of a row share their rank.
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, F.col("vec_id") % 20 == 0, 20)


#: Sums in the order in which numpy adds pairwise are out of SQL's reach, so its scores can differ in the last bits.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
