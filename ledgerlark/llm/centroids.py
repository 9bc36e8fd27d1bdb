"""Centroid clustering: exact integer k-means by partial-distance search.

Vectors become integers once and are written as fixed-width binaries, so a round reads them without decoding lists. A
round assigns every vector and sums each cluster's components within the task; Spark adds the tasks' sums, and only
one number per cluster and dimension comes to the driver. No vector is ever shuffled.

Partial distances: dimensions are taken in the order of their variance over all vectors. After the first few, the
centroid that is nearest so far is finished for each vector and gives its current best; the others accumulate further
dimensions and are abandoned once strictly above it. What survives has finished all dimensions, so results are exact
whatever the order, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q

#: Contract values of the query: centroids, rounds, components of a vector, their scale, and what an id is hashed after.
CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3:"
#: A scaled component beyond this could push a squared distance beyond 64 bits.
MOST = 1 << 27
#: Differences of vectors and centroids that are held at once.
HELD = 1 << 20


@dataclass(frozen=True)
class Clustering:
    """``rows``: ``id, cluster, distance`` of every kept vector; ``centroids``: the final ones, by number."""

    rows: DataFrame
    centroids: list[list[int]]


def kept(vector: Column, dim: int, scale: int) -> Column:
    """Vectors of ``dim`` components, none of them null, non-finite or beyond what distances can hold."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale > MOST))
    return vector.isNotNull() & (F.size(vector) == dim) & ~odd


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of int32 binaries as a matrix, without a copy of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", np.int32, len(column) * dim, int(offsets[0]) if len(column) else 0).reshape(-1, dim)


def as_integers(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """Rows ``id, vector`` of the kept vectors: floor(scale * x) of each component as int32, one binary a row."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(values * scale).astype(np.int32)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * dim)
            vectors = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "vector"])

    schema = T.StructType([T.StructField("id", df.select(q(id_col)).schema[0].dataType), T.StructField("vector", T.BinaryType())])
    return in_small_batches(df).where(kept(q(vector_col), dim, scale)).select(q(id_col), q(vector_col)).mapInArrow(turn, schema)


def assigned(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; dimensions count in ``order``."""
    vectors, centroids = vectors[:, order].astype(np.int64), centroids[:, order]
    cuts = [0, *(c for c in (8, 16, 32) if c < len(order)), len(order)]
    found, distances = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int64)
    step = max(1, HELD // (len(centroids) * cuts[1]))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        partial = ((part[:, None, : cuts[1]] - centroids[None, :, : cuts[1]]) ** 2).sum(2)
        best = ((part - centroids[partial.argmin(1)]) ** 2).sum(1)
        rows, numbers = np.nonzero(partial <= best[:, None])
        sums = partial[rows, numbers]
        for a, b in zip(cuts[1:], cuts[2:], strict=False):
            sums += ((part[rows, a:b] - centroids[numbers, a:b]) ** 2).sum(1)
            stay = sums <= best[rows]
            rows, numbers, sums = rows[stay], numbers[stay], sums[stay]
        ranked = np.lexsort((numbers, sums, rows))
        first = ranked[np.unique(rows[ranked], return_index=True)[1]]
        found[at : at + step], distances[at : at + step] = numbers[first], sums[first]
    return found, distances


def variance_order(rows: DataFrame, dim: int) -> np.ndarray:
    """Dimensions by variance over all vectors, largest first. It decides about work only, never about results."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            m = matrix(batch.column(0), dim).astype(np.float64)
            count, sums, squares = count + len(m), sums + m.sum(0), squares + (m * m).sum(0)
        columns = [pa.array(x) for x in (np.arange(dim, dtype=np.int32), np.full(dim, float(count)), sums, squares)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s", "ss"])

    parts = rows.select("vector").mapInArrow(moments, "i int, n double, s double, ss double")
    total = sorted(parts.groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("ss")).collect())
    spread = np.array([ss / n - (s / n) ** 2 if n else 0.0 for _, n, s, ss in total] or np.zeros(dim))
    return np.argsort(-spread, kind="stable")


def moved(rows: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays. Sums are whole numbers."""
    now, k, dim = np.array(centroids, np.int64), len(centroids), len(order)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            m = matrix(batch.column(0), dim)
            numbers, _ = assigned(m, now, order)
            for c in np.unique(numbers):
                own = m[numbers == c]
                total[c, 0] += len(own)
                total[c, 1:] += own.sum(0, dtype=np.int64)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[c, i])], names=["c", "i", "s"])

    found = {(r["c"], r["i"]): r["s"] for r in rows.select("vector").mapInArrow(sums, "c int, i int, s long").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()}
    means = lambda c, n: [found.get((c, i + 1), 0) // n for i in range(dim)]
    return [means(c, found[c, 0]) if (c, 0) in found else old for c, old in enumerate(centroids)]


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Kept vectors, assigned to ``k`` centroids that have moved ``rounds`` times.

    Centroids start as the kept vectors whose ids have the smallest sha256 (of ``seed`` and the id), in that order.

    Defined cases: vectors that are null, of another length, or hold a component that is null, non-finite or beyond
    2**27 when scaled are left out; of fewer than ``k`` kept vectors each starts a centroid; rows that repeat an id
    count one by one (as starts in the order of their vectors, so equal ones make a centroid that stays empty); a null
    id starts none, but is assigned; ties of distance go to the smaller number; an empty table gives an empty result;
    other columns are never read.
    """
    rows = written(as_integers(df, id_col, vector_col, dim, scale))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    starts = rows.where(F.col("id").isNotNull()).select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    centroids = [np.frombuffer(bytes(r["vector"]), np.int32).tolist() for r in starts]
    order = variance_order(rows, dim)
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, centroids, order) if centroids else centroids
        if before == centroids:  # any further round would repeat this one
            break
    final, schema = np.array(centroids, np.int64).reshape(-1, dim), T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = assigned(matrix(batch.column(1), dim), final, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers), pa.array(distances)], names=schema.names)
        give_back()

    return Clustering(rows.mapInArrow(last, schema) if centroids else df.sparkSession.createDataFrame([], schema), centroids)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cluster(read_table(spark, sf_dir, "embeddings"))
    rows = written(made.rows)
    total = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids]
    ends = [(c, total[c], sum(total.values()), digest) for c, digest in enumerate(digests) if c in total]
    per_cluster = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per_cluster), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, arg_min(k, d * {CLUSTERS} + k) AS k, min(d) AS d
  FROM (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY vec_id, k) GROUP BY vec_id)""")
        if n < ROUNDS:
            steps.append(f"""
s{n} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN x USING (vec_id) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (
  SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{n} LEFT JOIN s{n} USING (k, i))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, unnest(range(1, {DIM + 1})) AS i, unnest(e) AS x FROM v),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}' || CAST(vec_id AS VARCHAR))) - 1 AS k FROM v),
c0 AS MATERIALIZED (SELECT k, i, x AS c FROM f JOIN x USING (vec_id) WHERE k < {CLUSTERS}),{",".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{ROUNDS} JOIN h USING (k)
"""


ORACLE_SQL = _sql()
