"""Hard negatives and centroids against brute force, on vectors with ties, copies and every odd case."""

from __future__ import annotations

import hashlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import centroids, hard_negatives
from tests.llm.samples import clashing

SCHEMA = "vec_id long, embedding array<double>, label int"
ODD = [
    (900, None, 1), (901, [], 1), (902, [float("nan")] * 6, 2), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (904, [float("inf")] * 6, 0),
    (905, [0.5] * 6, None), (None, [0.5] * 6, 1), (906, [1e300] * 6, 1), (907, [0.5, 0.5], 1), (908, [0.25, 0.5], 1), (909, [0.5, 0.25], 2), (910, [0.0] * 6, 1),
]


def rows(n: int, dim: int = 6, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    made = [(i, np.round(rng.normal(size=dim) * 0.3 + (i % 3 == 0), 2).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    copies = [(n + i, made[5][1], [made[5][2], 3][i % 2]) for i in range(n // 3)]  # a third of all rows are one vector
    return [*made, *copies]


def plain_negatives(table: list[tuple], every: int) -> list[tuple]:
    held: dict[int, tuple] = {}
    for i, v, label in table:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) and abs(x) < 1e6 for x in v):
            held[i] = min(held.get(i, (label, v)), (label, v))
    whole = {i: (label, [floor(256 * x) for x in v]) for i, (label, v) in held.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        near = sorted((-dot(v, w), i, other == label) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in near if x[2]][:5]:
            fits = [(n, j) for n, j, same in near if not same and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, i, r, j, -p, -n) for r, (n, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "candidates", "cuts"), [(256, 4096, (8, 16, 32)), (3, 7, (1, 2, 4))])
def test_hard_negatives(spark, monkeypatch, anchors, candidates, cuts):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchors)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_BLOCK", candidates)
    monkeypatch.setattr(hard_negatives, "CUTS", cuts)
    table = [*rows(150), *ODD, rows(150)[7], rows(150)[10], (10, [9.0] * 6, 3)]
    df = clashing(spark.createDataFrame(table, SCHEMA)).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(table, 10)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(rows(12), SCHEMA)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives.hard_negatives(df.withColumn("label", F.lit(1)), F.lit(True)).count() == 0  # no other label


def test_few_pairs_survive(monkeypatch):
    """Pruning discards pairs, and none that counts: of clustered vectors few are verified."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    vectors = np.floor(256 * (centres[np.arange(2000) % 20] + 0.2 * rng.normal(size=(2000, 64)))).astype(np.int64)
    turn = np.linalg.eigh((vectors.T @ vectors).astype(float))[1][:, ::-1]
    side = lambda at: hard_negatives.Side.read(64, np.arange(2000)[at].tobytes(), np.zeros(2000, np.int64)[at].tobytes(), vectors[at].tobytes(), (vectors[at] @ turn).astype(np.float32).tobytes(), np.zeros((2000, 5), np.int64)[at].tobytes())
    left, right = side(slice(0, 100)), side(slice(None))
    n = len(left.ids)
    found, places = hard_negatives.surviving(left, right, np.ones((n, 2000), bool), np.full(n, -np.inf), np.full(n, np.inf), 6)
    products = vectors[:100] @ vectors.T
    assert len(found) < n * 2000 / 20
    kept = set(zip(found.tolist(), places.tolist(), strict=True))
    least = np.sort(products, 1)[:, -6]
    assert all((i, j) in kept for i, j in zip(*np.nonzero(products >= least[:, None]), strict=True))


def plain_clusters(table: list[tuple], k: int, rounds: int, dim: int) -> dict:
    kept = [(i, [floor(1024 * x) for x in v]) for i, v, *_ in table if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, np.int32).tobytes(), v) for i, v in kept if i is not None)
    centroids_ = [v for *_, v in order[:k]]
    distance = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids_))[::-1]
    for _ in range(rounds):
        at = [nearest(v)[0] for _, v in kept]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            centroids_[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return {"rows": sorted(((i, *nearest(v)) for i, v in kept), key=str), "centroids": centroids_}


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 1), (1, 2)])
def test_clusters(spark, k, rounds):
    table = [*rows(90), *ODD, rows(90)[7]]
    df = clashing(spark.createDataFrame(table, SCHEMA)).repartition(3)
    got = centroids.cluster(df, k, rounds, dim=6)
    want = plain_clusters(table, k, rounds, 6)
    assert got.centroids == want["centroids"]
    assert sorted(map(tuple, got.rows.collect()), key=str) == want["rows"]


def test_clusters_of_few_or_none(spark):
    df = spark.createDataFrame(rows(90), SCHEMA)
    few = centroids.cluster(df.where("vec_id < 3"), dim=6)
    assert len(few.centroids) == 3 and {r["distance"] for r in few.rows.collect()} == {0}
    none = centroids.cluster(df, dim=64)
    assert none.centroids == [] and none.rows.count() == 0


def test_partial_distances_lose_nothing():
    rng = np.random.default_rng(2)
    vectors, middle = rng.integers(-50, 50, (500, 64), np.int64).astype(np.int32), rng.integers(-50, 50, (9, 64))
    middle[4] = middle[2]  # a tie of every vector
    numbers, distances = centroids.assigned(vectors, middle, rng.permutation(64))
    full = ((vectors[:, None] - middle) ** 2).sum(2)
    assert numbers.tolist() == full.argmin(1).tolist() and distances.tolist() == full.min(1).tolist()


def test_queries(spark, tmp_path):
    rng = np.random.default_rng(4)
    spark.createDataFrame([(i, rng.normal(size=64).tolist(), int(i % 10)) for i in range(210)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    r = centroids.op13_centroids(spark, str(tmp_path)).collect()
    assert len(r) == 210 and len({x.inertia for x in r}) == 1 and sum(x.distance for x in r) == r[0].inertia
    assert hard_negatives.op11_hard_negatives(spark, str(tmp_path)).columns[:3] == ["anchor_id", "positive_id", "rank"]
