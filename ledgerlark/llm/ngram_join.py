"""N-gram Jaccard join by chosen paths.

Texts become sets of word 5-grams; equal sets meet first, by a digest, and one of them speaks for all. Each run of the
join splits the sets recursively: a bucket samples places of a MinHash sketch (one, and in a quarter of all buckets a
second), and each of its sets moves on to the bucket of the token it has there. So a set follows several paths, and
two sets share a step with a chance equal to their similarity. A bucket of one is done, a small one is searched by
brute force on sketches, a large one is split again. All runs are split together, level by level; only sets of large
buckets go on to the next level.

Runs repeat until a pair at the threshold meets with the target chance, even if all its buckets are split to the end.
A bucket that three levels in a row don't split (its sets are near copies of each other), or that is still large after
the last level, is searched by its smallest set: what is like that one hangs on it, and only the others are compared
with all of the bucket, on sketches and in blocks. So texts that share boilerplate are split apart, and no large bucket
is taken for alike untried. What is found similar hangs together in components. Each is then searched exactly: every
pair of its sets, in blocks of bounded bytes, with the sets themselves. So a pair counts only if it is truly similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q
from .components import components
from .marks import marked, told

N = 5
#: Similarity of 4/5 at least; kept as a ratio so that the comparison is one of whole numbers.
SIMILAR = (4, 5)
#: Levels of a path at most, chance that a pair at the threshold meets if it is split so often (0.9996 if four times),
#: sets of a bucket that is small enough.
DEPTH, RECALL, SMALL = 8, 0.99, 64
#: A level splits a bucket if no child has so large a share of it, in per cent; so many levels in a row that don't end it.
UNSPLIT, STUCK = 80, 3
#: One bucket in so many samples a second place: 1.25 on average, as many as a pair at the threshold needs to meet in one.
SECOND = 4
#: Sketch size, and the share of equal places from which a pair is looked at: four standard deviations below SIMILAR.
SKETCH, PROMISING = 64, 0.6
#: Sets of a block of an exact search, and bytes; two blocks meet in one group.
BLOCK, BLOCK_BYTES = 128, 4 << 20
#: Sketches of a block.
SKETCH_BLOCK = 1024
_WORDS_AT_ONCE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.random.default_rng(5).integers(1, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(depth: int = DEPTH, recall: float = RECALL, similar: tuple[int, int] = SIMILAR) -> int:
    """Runs after which a pair at the threshold has met with the chance ``recall``, split to the last level each time."""
    met = 1.0
    for _ in range(depth):
        one = 1 - similar[0] / similar[1] * met
        met = 1 - ((1 - 1 / SECOND) * one + 1 / SECOND * one * one)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def children(paths: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and next paths: of each path with its set's sketch, by the token at the places that the path samples."""
    chosen = _mixed(paths)
    second = np.flatnonzero((chosen >> np.uint64(40)) % np.uint64(SECOND) == 0)
    rows = np.r_[np.arange(len(paths)), second]
    first = chosen % np.uint64(SKETCH)
    other = (first[second] + np.uint64(1) + (chosen[second] >> np.uint64(20)) % np.uint64(SKETCH - 1)) % np.uint64(SKETCH)
    place = np.r_[first, other].astype(np.int64)
    token = marks[rows, place].astype(np.uint64)
    return rows, _mixed(chosen[rows] + (token << np.uint64(8)) + place.astype(np.uint64))


def ngram_sets(texts: list[str], n: int = N) -> Iterator[np.ndarray]:
    """Of each text the ascending 64-bit hashes of its word n-grams, lower-cased; fewer words than n make one gram."""
    start = 0
    while start < len(texts):
        words, sizes = [], []
        while start < len(texts) and len(words) < _WORDS_AT_ONCE:
            own = texts[start].lower().split()
            words += own
            sizes.append(len(own))
            start += 1
        hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
        at = 0
        for size in sizes:
            own = hashes[at : at + size]
            at += size
            width = min(n, size)
            grams = np.zeros(size - width + 1 if size else 0, np.uint64)
            for k in range(width):
                grams = (grams ^ (grams >> np.uint64(29))) * _MIX + own[k : k + len(grams)]
            grams = (grams ^ (grams >> np.uint64(32))) * _MIX
            yield np.unique(grams ^ (grams >> np.uint64(29)))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The first gram in each of SKETCH orders, as 32 bits."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * _ORDERS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _id_type(df: DataFrame, id_col: str) -> T.DataType:
    return df.schema[id_col].dataType


def sketches(df: DataFrame, id_col: str, text_col: str, n: int, runs: int) -> DataFrame:
    """``id``; ``high, low``: digest of the set; ``n_grams``: its size; ``sketch``; ``paths``: the buckets of the first level (none of an empty set)."""
    schema = T.StructType([T.StructField("id", _id_type(df, id_col)), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType()))])
    roots = np.arange(1, runs + 1, dtype=np.uint64)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for grams in ngram_sets([t or "" for t in batch.iloc[:, 1]], n):
                high, low = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                own = sketch(grams)
                paths = children(roots, np.broadcast_to(own, (runs, SKETCH)))[1].view(np.int64) if len(grams) else []
                rows.append((high, low, len(grams), own.tobytes(), paths))
            out = pd.DataFrame(rows, columns=["high", "low", "n_grams", "sketch", "paths"])
            out.insert(0, "id", batch.iloc[:, 0].to_numpy())
            yield out
        give_back()

    return df.select(q(id_col), q(text_col)).mapInPandas(of, schema)


def split(buckets: DataFrame) -> DataFrame:
    """Rows ``path, rep, sketch, before, stuck`` on the next level."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                marks = np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(len(batch), SKETCH)
                rows, paths = children(batch["path"].to_numpy().view(np.uint64), marks)
                yield pd.DataFrame({"path": paths.view(np.int64)} | {c: batch[c].to_numpy()[rows] for c in ("rep", "sketch", "before", "stuck")})
        give_back()

    return buckets.mapInPandas(of, T.StructType([buckets.schema[c] for c in ("path", "rep", "sketch", "before", "stuck")]))


def levels(able: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Small buckets, and large ones that splitting leaves, of sets (``rep, sketch, paths``): rows ``path, rep, sketch, size, least``.

    ``least``: smallest set of the bucket.
    """
    sketched = able.select("rep", "sketch")
    nodes = able.select(F.explode("paths").alias("path"), "rep", F.lit(1 << 50).alias("before"), F.lit(0).alias("stuck"))
    small: list[DataFrame] = []
    left: list[DataFrame] = []
    for level in range(1, depth + 1):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
        shared = nodes.join(sizes, "path")
        shared = shared if level > 1 else shared.join(sketched, "rep")
        again = F.when(F.col("size") * 100 >= F.col("before") * UNSPLIT, F.col("stuck") + 1).otherwise(0)
        shared = written(shared.select("path", "rep", "sketch", "size", "least", again.alias("stuck")))
        rows = ["path", "rep", "sketch", "size", "least"]
        small.append(shared.where(F.col("size") <= SMALL).select(rows))
        large = shared.where(F.col("size") > SMALL)
        ends = F.lit(level == depth) | (F.col("stuck") >= STUCK)
        left.append(large.where(ends).select(rows))
        more = large.where(~ends)
        if level == depth or more.isEmpty():
            break
        nodes = written(split(more.select("path", "rep", "sketch", F.col("size").alias("before"), "stuck")))  # counted, then joined with its counts
    return reduce(DataFrame.unionAll, small), reduce(DataFrame.unionAll, left)


def candidate_links(able: DataFrame, depth: int) -> DataFrame:
    """``u, v`` of sets (``rep, sketch, paths``) whose sketches are alike, found in small buckets and in what is left of large ones."""
    small, left = levels(able, depth)
    links = promising_links(small.select("path", F.col("rep").alias("id"), "sketch"))
    return links.unionAll(left_links(left))


def left_links(left: DataFrame) -> DataFrame:
    """``u, v``: of large buckets, sets like the smallest one with it, and the others with all that they are like."""
    heads = left.where("rep = least").select("path", F.col("sketch").alias("head")).dropDuplicates(["path"])
    rows = left.join(heads, "path").withColumn("near", _alike(F.col("sketch"), F.col("head")))
    rows = written(rows.select("path", "rep", "sketch", "size", "least", "near"))
    star = rows.where(F.col("near") & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("u"), F.col("least").alias("v"))
    counts = rows.where(~F.col("near")).groupBy("path").agg(F.count("*").alias("others"))
    blocks = lambda n: F.ceil(F.col(n) / SKETCH_BLOCK).cast("int")
    met = rows.join(counts, "path").withColumn("at", F.xxhash64("rep"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    # Every block of the others meets every block of the bucket.
    stay = met.select("path", F.pmod("at", blocks("size")).cast("int").alias("i"), upto("others").alias("j"), F.col("rep").alias("id"), "sketch", F.lit(False).alias("other"))
    come = met.where(~F.col("near")).select("path", upto("size").alias("i"), F.pmod("at", blocks("others")).cast("int").alias("j"), F.col("rep").alias("id"), "sketch", F.lit(True).alias("other"))
    return star.unionAll(promising_links(stay.unionAll(come), ["path", "i", "j"]).where("u <> v"))  # each of the others is in the bucket too


def _alike(a: Column, b: Column) -> Column:
    """Whether two columns of sketches have as many equal places as a promising pair."""

    @F.pandas_udf("boolean")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            one, two = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, SKETCH) for s in (x, y))
            yield pd.Series((one == two).mean(1) >= PROMISING)
        give_back()

    return told(a, b)


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    """For each of n places the first place that pairs connect it with."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, several at a time: the last one of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield batch.iloc[:cut]
        rest = batch.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    values = [frame[k].to_numpy() for k in keys]
    change = np.zeros(len(frame), bool)
    change[0] = True
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(change), len(frame)]


def promising_links(buckets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``u, v``: sets that brute force over small buckets (``path, id, sketch``) finds alike, as a forest per bucket.

    With a column ``other`` only pairs are tried of which one is an ``other`` and the second isn't.
    """
    keys, parted = keys or ["path"], "other" in buckets.columns

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(batches, keys):
            marks = np.frombuffer(b"".join(frame["sketch"]), np.uint32).reshape(len(frame), SKETCH)
            starts, found = _starts(frame, keys), []
            for a, b in zip(starts, starts[1:], strict=False):
                if parted:
                    other = frame["other"].to_numpy()[a:b]
                    stay = np.flatnonzero(~other)
                    near = [(np.full(n.sum(), k), stay[n]) for k in np.flatnonzero(other) if (n := (marks[a + k] == marks[a + stay]).mean(1) >= PROMISING).any()]
                    pairs = np.stack([np.concatenate(x) for x in zip(*near, strict=True)], 1) if near else np.zeros((0, 2), np.int64)
                else:
                    i, j = np.triu_indices(b - a, 1)
                    near = (marks[a + i] == marks[a + j]).mean(1) >= PROMISING
                    pairs = np.stack([i[near], j[near]], 1)
                if len(pairs):
                    found += [(a + x, a + r) for x, r in enumerate(_roots(b - a, pairs)) if x != r]
            if found:
                at = np.array(found)
                ids = frame["id"].to_numpy()
                yield pd.DataFrame({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})
        give_back()

    kind = buckets.schema["id"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    return buckets.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, schema)


def exact_links(blocks: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """From ``part, i, j, id, block, grams``: ``id, n_links, root`` of each set for each pair of blocks it is in.

    ``root`` is the smallest id that similar pairs of the two blocks connect the set with.
    """
    over, under = similar

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["part", "i", "j"]
        for frame in _groups(batches, keys):
            starts = _starts(frame, keys)
            for a, b in zip(starts, starts[1:], strict=False):
                own = frame.iloc[a:b].sort_values("id")
                sets = [np.frombuffer(g, np.uint64) for g in own["grams"]]
                sizes = np.array([len(s) for s in sets])
                owner = np.repeat(np.arange(len(sets)), sizes)
                _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                shared = np.flatnonzero(times > 1)
                number = np.full(len(times), -1)
                number[shared] = np.arange(len(shared))
                column = number[column]
                both = np.zeros((len(sets), len(sets)))
                for at in range(0, len(shared), 4096):
                    part = (column >= at) & (column < at + 4096)
                    matrix = np.zeros((len(sets), 4096), np.float32)
                    matrix[owner[part], column[part] - at] = 1
                    both += matrix @ matrix.T
                # |x & y| / |x | y| >= over / under, in whole numbers
                near = both * (over + under) >= over * (sizes[:, None] + sizes)
                np.fill_diagonal(near, False)
                block = own["block"].to_numpy()
                if own["i"].iloc[0] != own["j"].iloc[0]:
                    near &= block[:, None] != block
                pairs = np.argwhere(np.triu(near))
                ids = own["id"].to_numpy()
                yield pd.DataFrame({"id": ids, "n_links": near.sum(1), "root": ids[_roots(len(ids), pairs)]})
        give_back()

    kind = blocks.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_links", T.LongType()), T.StructField("root", kind)])
    return blocks.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInPandas(search, schema)


def gram_sets(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", _id_type(df, id_col)), T.StructField("grams", T.BinaryType())])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                yield pd.DataFrame({"id": part.iloc[:, 0], "grams": [g.tobytes() for g in ngram_sets([t or "" for t in part.iloc[:, 1]], n)]})
        give_back()

    return df.select(q(id_col), q(text_col)).mapInPandas(of, schema)


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similar: tuple[int, int] = SIMILAR, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """``id_col, class_id, n_links, n_copies`` for every row of ``df``.

    ``class_id``: smallest id that a chain of similar pairs leads to; ``n_links``: other different sets of at least
    that similarity (copies count once); ``n_copies``: rows of the same set, the row itself included.

    Defined cases: null texts and texts without words have the empty set: copies of each other, similar to no other;
    texts of fewer than n words are one gram; rows of a null id count as copies but take no part in links, and have
    class null unless another row has their set; rows that repeat an id should repeat its text; texts of any length
    are read whole; other columns are never read; an empty table gives an empty result.
    """
    runs = runs_needed(depth, recall, similar)
    rows = written(sketches(in_small_batches(df), id_col, text_col, n, runs))
    sets = rows.groupBy("high", "low").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    sets = written(sets)
    links = candidate_links(sets.where(F.col("rep").isNotNull()), depth)
    part = written(components(links))
    part = part.join(sets.select(F.col("rep").alias("node"), "n_grams"), "node")
    parts = part.groupBy("component").agg(F.count("*").alias("size"), F.sum("n_grams").alias("n_grams"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("n_grams") / BLOCK_BYTES)).cast("int")
    placed = part.drop("n_grams").join(parts, "component").select(F.col("node").alias("id"), F.col("component").alias("part"), blocks.alias("n_blocks"))
    placed = written(placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")))
    # Sets are made again where a row's id is marked, then joined: no text moves. A row that repeats counts once.
    able = told(df.select(q(id_col).alias("id"), q(text_col).alias("text")), marked(placed, "id"), [F.col("id")], "often").where("often")
    wanted = gram_sets(able, "id", "text", n).join(placed, "id").dropDuplicates(["id"])
    # A large component's sets go to every pair of blocks that their own is in.
    blocks = wanted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    blocks = blocks.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "grams")
    found = written(exact_links(blocks, similar))
    classes = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    linked = counts.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumnRenamed("id", "rep")
    named = sets.select("high", "low", "rep", "n_copies").join(linked, "rep", "left")
    out = rows.select("id", "high", "low").join(named, ["high", "low"])
    return out.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))
