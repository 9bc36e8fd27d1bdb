"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, level by level. A level first makes each run of
equal symbols one symbol, so neighbours differ; then deterministic coin tossing: a symbol's label is the lowest bit in
which it differs from its left neighbour, and that bit; tossed again and again, labels fall to six, neighbours still
differing. A phrase begins where a label is lower than both its neighbours', so every phrase is short, and where it
begins depends on a few symbols around it alone. A phrase's name is a hash of its symbols. So equal substrings are cut
alike and named alike but for a few phrases at their ends, wherever they stand.

A fingerprint holds, for each of two levels (phrases of some 6 and some 15 bytes on ordinary text), the smallest
names: all of a short text, a sample of fixed size of a long one that is the same wherever the text is. Two
fingerprints tell how large a share of their phrases two texts have in common.

Texts are parsed many at once, as arrays. For the query, documents are dealt into ranges of ids of equal size, each
with the first document of the range after it as a guest; so a task sees every document's successor, and one shuffle
of the texts is all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .columns import fresh, give_back, in_small_batches, q

#: Levels whose phrases a fingerprint holds, and how many names of each.
LEVELS, NAMES = (2, 3), 64
#: Bytes that are parsed at once, at least a text.
AT_ONCE = 1 << 20
_ONE, _GOLD, _A, _B = (np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)
#: A symbol's weight by its place in a phrase; phrases are shorter than this, as labels fall and rise within ten places.
_WEIGHTS = _mixed(np.arange(1, 65, dtype=np.uint64) * _A) | _ONE
#: The label of a label (second) to the right of another (first): the lowest bit in which they differ, and that bit.
_i, _j = np.divmod(np.arange(1 << 16, dtype=np.uint32), np.uint32(256))
_low = np.bitwise_count(np.where(_i == _j, 1, (_i ^ _j) & (~(_i ^ _j) + np.uint32(1))) - 1).astype(np.uint8)
_TOSS = (2 * _low + ((_j >> _low) & 1)).astype(np.uint8)


def _tossed(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A label of 0 to 5 for each symbol, other than its neighbours'. A text's first symbol counts as differing from nothing in bit 0."""
    differ = np.empty_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=differ[1:])
    differ[first] = _ONE
    differ[differ == 0] = _ONE
    low = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint8)
    labels = 2 * low + ((names >> low) & _ONE).astype(np.uint8)
    for _ in range(3):  # 128 labels become 14, then 8, then 6
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = labels[first] ^ 1
        labels = _TOSS[before.astype(np.uint16) << 8 | labels]
    return labels


def phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a sequence of symbols, and the places among them where a text begins.

    ``first``: the places, ascending, where a text begins; what stands before has no bearing on it.
    """
    if not len(names):
        return names, first
    begins = np.zeros(len(names), bool)
    begins[first] = True
    starts = np.flatnonzero(begins | np.r_[True, names[1:] != names[:-1]])
    length, names, begins = np.diff(starts, append=len(names)), names[starts], begins[starts]
    if (length > 1).any():
        names = np.where(length > 1, _mixed(names + length.astype(np.uint64) * _GOLD), names)
    first = np.flatnonzero(begins)
    labels = _tossed(names, first)
    lower = np.zeros(len(names), bool)
    lower[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    lower[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    starts = np.flatnonzero(lower | begins)
    size = np.diff(starts, append=len(names))
    place = np.arange(len(names)) - np.repeat(starts, size)
    sums = np.add.reduceat(names * _WEIGHTS[place & 63], starts)
    return _mixed(sums + size.astype(np.uint64) * _GOLD), np.flatnonzero(begins[starts])


def _smallest(names: np.ndarray, first: np.ndarray, n: int) -> list[str]:
    """The smallest different names of each text, in order, as 8 hexadecimal digits each."""
    owner = np.repeat(np.arange(len(first)), np.diff(first, append=len(names)))
    short = names >> np.uint64(32)
    key = np.sort(owner.astype(np.uint64) << np.uint64(32) | short)
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    owner = (key >> np.uint64(32)).astype(np.int64)
    starts = np.searchsorted(owner, np.arange(len(first) + 1))
    digits = key.astype(np.uint32).astype(">u4").tobytes().hex()
    return [digits[8 * a : 8 * min(a + n, b)] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _parsed(data: list[bytes]) -> list[str]:
    """Fingerprints of texts that aren't empty."""
    size = np.array([len(x) for x in data])
    names, first = _BYTES[np.frombuffer(b"".join(data), np.uint8)], np.cumsum(size) - size
    found = []
    for level in range(1, max(LEVELS) + 1):
        names, first = phrases(names, first)
        if level in LEVELS:
            found.append(_smallest(names, first, NAMES))
    return ["-".join(x) for x in zip(*found, strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: names of each level, levels parted by a dash; empty of an empty text."""
    data = [x.encode("utf-8", "surrogatepass") for x in texts]
    out, waiting, held = [""] * len(data), [], 0
    for i, x in enumerate(data):
        if x:
            waiting.append(i)
            held += len(x)
        if waiting and (held >= AT_ONCE or i == len(data) - 1):
            for k, f in zip(waiting, _parsed([data[k] for k in waiting]), strict=True):
                out[k] = f
            waiting, held = [], 0
    return out


Names = tuple[set[str], ...]


def names_of(fingerprint: str) -> Names:
    """The names that a fingerprint holds, of each level; nothing of an empty one."""
    return tuple({level[i : i + 8] for i in range(0, len(level), 8)} for level in fingerprint.split("-")) if fingerprint else ()


def likeness(a: Names, b: Names) -> float:
    """The share of their phrases that two texts have in common, the mean of the levels: 1 of equal ones, 0 if one alone is empty.

    Exact for texts of less than NAMES phrases a level, else an estimate from the smallest names of both together.
    """
    if a == b:
        return 1.0
    total = 0.0
    for own, other in zip(a, b, strict=False):
        common = own & other
        if common:
            both = own | other
            if max(len(own), len(other)) >= NAMES:
                both = set(sorted(both)[:NAMES])
                common &= both
            share = len(common) / len(both)
            total += 2 * share / (1 + share)
    return total / len(LEVELS)


def fingerprinted(df: DataFrame, text_col: str = "text", result_col: str = "fingerprint") -> DataFrame:
    """Every row of ``df`` with the fingerprint of its text.

    Defined cases: null counts as empty, and the fingerprint of an empty text is empty; texts of any length are read
    whole; repeated rows are read one by one; an empty table gives an empty result; a taken name gets an underscore.
    """

    @F.pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints([x or "" for x in texts]), dtype=object)
        give_back()

    (name,) = fresh(df, result_col)
    return in_small_batches(df).withColumn(name, told(q(text_col)))


def likeness_of(a: Column, b: Column) -> Column:
    """:func:`likeness` of two columns of fingerprints; a null counts as empty."""

    @F.pandas_udf("double")
    def told(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(names_of(s or ""), names_of(t or "")) for s, t in zip(x, y, strict=True)], dtype="float64")

    return told(a, b)


def in_ranges(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``range, guest, id, text``: rows dealt into as many ranges of ids as there are shuffle partitions, in order within each.

    After a range's own rows come guests: the first row of the next range that has any (of the first, after the last).
    Bounds are percentiles of all ids, so ranges hold about as many rows each; they and each range's first id, a number
    for each range, come to the driver.
    """
    spark, key = df.sparkSession, q(id_col).cast("long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / n for i in range(1, n)]
    (found,) = df.agg(F.percentile_approx(key, points, 100_000) if points else F.lit(None)).first()
    bounds = sorted(set(found or ()))
    step = max(1, int(len(bounds) ** 0.5))
    # The number of bounds that an id reaches, by groups of them first; a null comes before all.
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    fine, coarse = (F.lit(x) if x else F.array().cast("array<long>") for x in (bounds, bounds[::step]))
    base = F.greatest(below(coarse) - 1, F.lit(0)) * step
    place = F.when(key.isNull() | (F.size(fine) == 0), 0).otherwise(base + below(F.slice(fine, base + 1, F.lit(step)))).cast("int")
    ends = {r["range"]: None if r["nulls"] else r["least"] for r in df.groupBy(place.alias("range")).agg(F.min(key).alias("least"), F.max(key.isNull()).alias("nulls")).collect()}
    full = sorted(ends)
    before = dict(zip(full, full[-1:] + full[:-1], strict=True))
    none = F.lit(None).cast("long")
    leasts = F.array(*[F.lit(ends[r]).cast("long") if r in ends else none for r in range(len(bounds) + 1)])
    hosts = F.array(*[F.lit(before.get(r, 0)) for r in range(len(bounds) + 1)])
    own = F.struct(F.col("place").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(hosts, F.col("place")).alias("range"), F.lit(True).alias("guest"))
    rows = df.select(key.alias("id"), F.coalesce(q(text_col), F.lit("")).alias("text"), place.alias("place"))
    is_first = F.col("id").eqNullSafe(F.get(leasts, F.col("place")))
    rows = rows.select("id", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("at.*", "id", "text")
    return rows.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("guest", "id", F.xxhash64("text"), "text")


EDITED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text is the text with its last quarter of code points replaced by the first as many, or all, of the next
    document, ids ascending; after the last comes the first.

    Defined cases: a null text counts as empty; null ids come before all others; rows that repeat an id are documents
    of their own, in the order of their texts' hashes, then of their texts; a document alone is its own next one; texts
    of any length are read whole; an empty table gives an empty result; other columns are never read.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, text, fingerprint and names of the row that waits for its next
        ended = False
        for batch in batches:
            guests, ids, texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            at = 0
            while at < len(ids) and not ended:
                end, size = at, 0
                while end < len(ids) and size < AT_ONCE:
                    size += len(texts[end])
                    end += 1
                part = [(i, x, f, names_of(f)) for i, x, f in zip(ids[at:end], texts[at:end], fingerprints(texts[at:end]), strict=True)]
                if True in guests[at:end]:  # the first guest ends the range
                    part, ended = part[: guests.index(True, at) - at + 1], True
                at = end
                part = ([last] if last else []) + part
                last = part[-1]
                pairs = list(zip(part, part[1:], strict=False))
                cut = [a[1][: len(a[1]) - len(a[1]) // 4] + b[1][: len(a[1]) // 4] for a, b in pairs]
                made = fingerprints(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in cut], pa.string()), pa.array([a[2] for a, _ in pairs], pa.string()), pa.array(made, pa.string()),
                        pa.array([likeness(a[3], names_of(f)) for (a, _), f in zip(pairs, made, strict=True)], pa.float64()), pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    ],
                    names=[x.split()[0] for x in EDITED.split(", ")],
                )
        give_back()

    return in_ranges(in_small_batches(df), id_col, text_col).mapInArrow(told, EDITED)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
