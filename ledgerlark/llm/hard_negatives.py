"""Hard negatives by integer inner product, pruned in the axes of an orthogonal PCA rotation.

Vectors become integers; their second moments, summed over all rows, give an orthogonal rotation that puts what most
products are made of into the leading components. In a tile (a block of anchors times a block of candidates) products
accumulate component group by component group. What is left of a product is at most the product of the two residual
norms, plus slack for rounding, so a pair whose product surely lies outside what is asked for is discarded early.
Survivors are verified with products of the integers themselves: nothing that counts is lost, and results are exact.

Two passes: the first finds each anchor's positives, the second, for each positive's score, the best rows of other
labels within a window below it. Blocks meet in the cells of a grid, as in :mod:`.nearest`; a task holds one tile and
the heaps of one cell, and Spark ranks what cells found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q
from .nearest import CELL, first_copies, grid

#: Contract values of the query: what components are scaled by, positives of an anchor, negatives of a positive, and the window in per cent.
SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 5, (80, 100)
#: Rows of a block of anchors and of candidates, and bytes of a block of long vectors.
ANCHOR_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES = 256, 4096, 4 << 20
#: Leading components after which pairs are discarded, and pairs that are taken at once when they are few.
CUTS, PAIRS = (8, 16, 32, 64, 128, 256), 50_000
_BLOCK = "block long, dim int, ids binary, labels binary, vectors binary, turned binary, asked binary"
_MISSING = np.iinfo(np.int64).min


def usable(vector: Column, scale: int) -> Column:
    """Not null or empty, without null or non-finite components, and so small that a hundred times any product fits 64 bits."""
    most = F.sqrt(F.lit(float(1 << 55)) / F.size(vector))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale + 1 > most))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def integers(vectors: pd.Series, scale: int) -> np.ndarray:
    return np.floor(np.stack(vectors.to_list()).astype(np.float64) * scale).astype(np.int64)


def rotations(rows: DataFrame, scale: int) -> dict[int, np.ndarray]:
    """An orthogonal rotation for each length of vector, its axes by falling second moment over all rows.

    Tasks add up products of components, Spark adds up the tasks': a number for each pair of components comes to the driver.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, group in batch.groupby(batch["vector"].map(len)):
                m = integers(group["vector"], scale).astype(np.float64)
                total[dim] = total.get(dim, 0.0) + m.T @ m
        for dim, m in total.items():
            i, j = np.triu_indices(dim)
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "m": m[i, j]})

    parts = rows.select("vector").mapInPandas(moments, "dim int, i int, j int, m double")
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("m").alias("m")).collect():
        m = found.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["m"]
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in found.items()}


def blocks_of(rows: DataFrame, size: int, scale: int, turns: dict[int, np.ndarray]) -> DataFrame:
    """Rows ``id, label, vector, asked`` as written blocks of vectors of one length, as they lie in the tasks: nothing is shuffled."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, labels, vectors, asked = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
            turned = (vectors @ turns[dim]).astype(np.float32)
            return pd.DataFrame([(0, dim, ids.tobytes(), labels.tobytes(), vectors.tobytes(), turned.tobytes(), asked.tobytes())], columns=["block", "dim", "ids", "labels", "vectors", "turned", "asked"])

        for batch in batches:
            for dim, group in batch.groupby(batch["vector"].map(len)):
                most = max(1, min(size, BLOCK_BYTES // (8 * dim)))
                asked = np.array([[*x, *[_MISSING] * (POSITIVES - len(x))] for x in group["asked"]], np.int64).reshape(len(group), -1)
                whole = group["id"].to_numpy(np.int64), group["label"].to_numpy(np.int64), integers(group["vector"], scale), asked
                for at in range(0, len(group), most):
                    waiting.setdefault(dim, []).append(tuple(x[at : at + most] for x in whole))
                    if sum(len(p[0]) for p in waiting[dim]) >= most:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)
        give_back()

    return written(rows.select("id", "label", "vector", "asked").mapInPandas(cut, _BLOCK).withColumn("block", F.monotonically_increasing_id()))


@dataclass
class Side:
    """One side of a tile: integers, their rotated forms, and the length of what each cut leaves of them."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    turned: np.ndarray
    asked: np.ndarray
    cuts: list[int]
    rest: np.ndarray

    @classmethod
    def read(cls, dim: int, ids: bytes, labels: bytes, vectors: bytes, turned: bytes, asked: bytes) -> Side:
        n = len(ids) // 8
        cuts = [0, *(c for c in CUTS if c < dim), dim]
        wide = np.frombuffer(turned, np.float32).reshape(n, dim)
        squares = np.cumsum(wide[:, ::-1].astype(np.float64) ** 2, 1)[:, ::-1]
        rest = np.sqrt(np.stack([squares[:, c] if c < dim else np.zeros(n) for c in cuts], 1))
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int64).reshape(n, dim), wide, np.frombuffer(asked, np.int64).reshape(n, -1), cuts, rest)

    def only(self, places: np.ndarray) -> Side:
        return Side(self.ids[places], self.labels[places], self.vectors[places], self.turned[places], self.asked[places], self.cuts, self.rest[places])

    def without_copies(self, most: int) -> Side:
        """Of rows of one vector and label the ``most`` of smallest ids: no more of equal ones can be asked for."""
        return self.only(first_copies(self.ids, np.column_stack([self.labels, self.vectors]), most))


def surviving(left: Side, right: Side, alive: np.ndarray, low: np.ndarray, high: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs, among those alive, whose product may lie from ``low`` to ``high`` of its row of ``left``.

    With ``best``, the row's ``best`` largest products alone are asked for: as many lower bounds raise ``low``.
    """
    low, dim = low.copy(), left.cuts[-1]
    # Single precision: rounded components, and sums whose rounding grows with their number; twice that for good measure.
    slack = (4 * dim + 16) * 2.0**-24
    wide, narrow = slack * left.rest[:, 0], right.rest[:, 0]
    products, at = np.zeros(alive.shape, np.float32), 1
    for at in range(1, len(left.cuts)):
        a, b = left.cuts[at - 1 : at + 1]
        products += left.turned[:, a:b] @ right.turned[:, a:b].T
        room = left.rest[:, at, None] * right.rest[:, at] + wide[:, None] * narrow
        if best and alive.shape[1] > best:
            lower = np.where(alive, products - room, -np.inf)
            low = np.maximum(low, np.partition(lower, -best, axis=1)[:, -best])
        alive = alive & (products + room >= low[:, None]) & (products - room <= high[:, None])
        if 4 * np.count_nonzero(alive) < alive.size:
            break
    rows, places = np.nonzero(alive)
    sums = products[rows, places].astype(np.float64)
    for n in range(at + 1, len(left.cuts)):
        a, b = left.cuts[n - 1 : n + 1]
        for x in range(0, len(rows), PAIRS):
            p = slice(x, x + PAIRS)
            sums[p] += (left.turned[rows[p], a:b] * right.turned[places[p], a:b]).sum(1)
        room = left.rest[rows, n] * right.rest[places, n] + wide[rows] * narrow[places]
        stay = (sums + room >= low[rows]) & (sums - room <= high[rows])
        rows, places, sums = rows[stay], places[stay], sums[stay]
    return rows, places


def verified(left: Side, right: Side, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Products of the integers."""
    scores = np.empty(len(rows), np.int64)
    for x in range(0, len(rows), PAIRS):
        p = slice(x, x + PAIRS)
        scores[p] = (left.vectors[rows[p]] * right.vectors[places[p]]).sum(1)
    return scores


def best_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: larger scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    ranked = groups[order]
    starts = np.r_[True, ranked[1:] != ranked[:-1]]
    since = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[since < k]


class Heaps:
    """The k best of each key so far: larger scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key: tuple[int, int], score: int, found: int) -> None:
        heap = self.held.setdefault(key, [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -found))
        elif (score, -found) > heap[0]:
            heapq.heapreplace(heap, (score, -found))

    def least(self, key: tuple[int, int]) -> float:
        heap = self.held.get(key, ())
        return heap[0][0] if len(heap) == self.k else -np.inf

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(*key, -found, score) for key, heap in self.held.items() for score, found in heap], columns=["anchor", "place", "found", "score"])


def add_positives(left: Side, right: Side, heaps: Heaps) -> None:
    """Rows of the anchor's own label, in one tile; label by label, so other labels cost nothing."""
    right = right.without_copies(heaps.k + 1)
    for label in np.unique(left.labels):
        own, same = left.only(left.labels == label), right.only(right.labels == label)
        if not len(same.ids):
            continue
        low = np.array([heaps.least((i, 0)) for i in own.ids.tolist()])
        rows, places = surviving(own, same, own.ids[:, None] != same.ids, low, np.full(len(low), np.inf), heaps.k)
        scores = verified(own, same, rows, places)
        for x in best_of(rows, scores, same.ids[places], heaps.k).tolist():
            heaps.add((int(own.ids[rows[x]]), 0), int(scores[x]), int(same.ids[places[x]]))


def add_negatives(left: Side, right: Side, heaps: Heaps, window: tuple[int, int]) -> None:
    """Rows of other labels within the window below each positive's score, in one tile."""
    right = right.without_copies(heaps.k)
    asked, (least, most) = left.asked, window
    open_ = asked > 0  # a window below a negative score is empty; zero has only itself
    zero = asked == 0
    floor = np.where(open_, -(-least * asked // 100), 0)
    ceiling = np.where(open_, most * asked // 100, 0)
    held = np.array([[heaps.least((i, j)) for j in range(asked.shape[1])] for i in left.ids.tolist()]).reshape(asked.shape)
    some = open_ | zero
    low = np.where(some, np.maximum(floor, held), np.inf).min(1, initial=np.inf)
    high = np.where(some, ceiling, -np.inf).max(1, initial=-np.inf)
    rows, places = surviving(left, right, left.labels[:, None] != right.labels, low, high)
    scores = verified(left, right, rows, places)
    for j in range(asked.shape[1]):
        fits = np.flatnonzero(some[rows, j] & (scores >= floor[rows, j]) & (scores <= ceiling[rows, j]))
        for x in fits[best_of(rows[fits], scores[fits], right.ids[places[fits]], heaps.k)].tolist():
            heaps.add((int(left.ids[rows[x]]), j), int(scores[x]), int(right.ids[places[x]]))


def searched(asked: DataFrame, stored: DataFrame, k: int, add) -> DataFrame:
    """``anchor, place, rank, found, score``: what ``add`` finds of each anchor in all tiles, the k best of each place."""
    high, wide = grid(asked.count(), stored.count(), asked.sparkSession.sparkContext.defaultParallelism)
    at = F.shiftright("block", 33) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1)) * 7919
    names = ("ids", "labels", "vectors", "turned", "asked")
    left = asked.select("dim", F.pmod(at, F.lit(high)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("col"), *[F.col(n).alias(f"anchor_{n}") for n in names])
    right = stored.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("row"), F.pmod(at, F.lit(wide)).cast("int").alias("col"), *names)
    # Spark buffers the side that is named second: the smaller one, the anchors of a cell.
    tiles = right.join(left.hint("merge"), ["dim", "row", "col"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, heaps = None, Heaps(k)
        for batch in batches:
            for r in batch.itertuples():
                if (r.dim, r.row, r.col) != cell:  # a merge join gives all tiles of a cell one after the other
                    yield heaps.rows()
                    cell, heaps = (r.dim, r.row, r.col), Heaps(k)
                anchors = Side.read(r.dim, r.anchor_ids, r.anchor_labels, r.anchor_vectors, r.anchor_turned, r.anchor_asked)
                add(anchors, Side.read(r.dim, r.ids, r.labels, r.vectors, r.turned, r.asked), heaps)
        yield heaps.rows()
        give_back()

    found = tiles.mapInPandas(best, "anchor long, place int, found long, score long")
    # Spark keeps the k best of each group before it shuffles, and again after.
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor", "place", "rank", "found", "score")


def hard_negatives(df: DataFrame, anchors: Column, k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(scale * x); higher ones first, ties to the smaller id. An anchor (a row where
    ``anchors`` holds) has as positives its first ``k_positives`` other rows of its label; each positive as negatives
    the first ``k_negatives`` rows of other labels whose score is within ``window`` per cent of the positive's.

    Defined cases: rows of a null id or label, and vectors that are null, empty, or hold a component that is null,
    non-finite or so large that a hundred times a product could leave 64 bits take no part; vectors of different lengths are never
    compared; of rows that repeat an id the one of smallest label, then vector, counts; a negative positive score has
    an empty window, a score of zero has the window of zero; an anchor without positives, or a positive without
    negatives, gives no row; an empty table gives an empty result; other columns are never read.
    """
    if k_positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives of an anchor")
    rows = in_small_batches(df).select(q(id_col).cast("long").alias("id"), q(label_col).cast("long").alias("label"), q(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), scale))
    rows = written(rows.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("r")).select("id", "r.*"))
    turns = rotations(rows, scale)
    nothing = F.array().cast("array<long>").alias("asked")
    stored = blocks_of(rows.select("*", nothing), CANDIDATE_BLOCK, scale, turns)
    chosen = rows.where("asks")
    asked = blocks_of(chosen.select("*", nothing), ANCHOR_BLOCK, scale, turns)
    positives = written(searched(asked, stored, k_positives, add_positives))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])  # five at most
    again = chosen.join(positives.groupBy("anchor").agg(scores.alias("asked")).withColumnRenamed("anchor", "id"), "id")
    negatives = searched(blocks_of(again, ANCHOR_BLOCK, scale, turns), stored, k_negatives, lambda a, c, h: add_negatives(a, c, h, window))
    of = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
