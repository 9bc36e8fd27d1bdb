"""Suffix-array dedup with sparse suffix arrays.

Of each text only the suffixes at minimiser positions are retained: places whose word n-gram hashes lowest within a
window, so that any passage of MIN_WORDS words, wherever it stands, has one of its suffixes retained. Suffixes whose
first n-gram occurs nowhere else are dropped by a sum of fixed-size values. The others are sorted by their words;
each is compared with its nearest earlier ones in that order, and a match is extended to the right and to the left.
What is reported always occurs before, so the first occurrence of any passage stays.

The sort is Spark's range sort down to the document and position, so suffixes that a third of all texts share lie in
many tasks. That such a task misses what lies in others, and that neighbours share the most to the right but not to
both sides, is made up for: each suffix is compared with the earliest of its key, and hashes tell the passages of
MIN_WORDS words it stands for and doesn't share with that one. So the result doesn't depend on how rows are dealt out.
A suffix carries MIN_WORDS words to the right and what its passages have to the left of it: what a longer repeat has
beyond that, its next minimiser covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q
from .marks import marked, told, without
from .spans import joined_spans, told_spans

#: A repeat has this many words; the n-gram that is hashed; the window. GRAM + WINDOW - 1 is MIN_WORDS.
MIN_WORDS, GRAM, WINDOW = 50, 20, 31
_WORDS_AT_ONCE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, lower-cased and cut at white space."""
    start = 0
    while start < len(texts):
        words, sizes = [], []
        while start < len(texts) and len(words) < _WORDS_AT_ONCE:
            own = texts[start].lower().split()
            words += own
            sizes.append(len(own))
            start += 1
        hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
        yield from np.split(hashes, np.cumsum(sizes)[:-1])


def minimisers(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Positions whose n-gram hashes lowest (the leftmost of equals) in a window, those hashes, and the first and last window of each.

    A window is a passage of MIN_WORDS words, and its position depends on its words alone; so equal passages, wherever
    they stand, have it at the same place.
    """
    n = len(words) - gram + 1
    if len(words) < gram + window - 1:
        return (np.zeros(0, np.int64),) * 4
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX + words[k : k + n]
    grams ^= grams >> np.uint64(32)
    least, width = np.arange(n), 1
    while width < window:  # doubles the width of the windows whose minimum is known
        step = min(width, window - width)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(grams[b] < grams[a], b, a)
        width += step
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    places = least[first]
    return places, grams[places].view(np.int64), first, np.r_[first[1:], len(least)] - 1


def _digest(text: Column) -> list[Column]:
    """96 bits that tell texts apart."""
    return [F.xxhash64(text).alias("text_a"), F.hash(text).alias("text_b")]


def _keys(texts: DataFrame) -> DataFrame:
    """``key, text_a, again`` of the suffixes of ``text, text_a``; ``again``: the key repeats in its text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                found = [np.unique(minimisers(words)[1], return_counts=True) for words in word_hashes([t or "" for t in part["text"]])]
                owner = np.repeat(np.arange(len(part)), [len(k) for k, _ in found])
                yield pd.DataFrame({"key": np.concatenate([k for k, _ in found]), "text_a": part["text_a"].to_numpy()[owner], "again": np.concatenate([n > 1 for _, n in found])})
        give_back()

    return texts.mapInPandas(of, "key long, text_a long, again boolean")


def _contexts(texts: DataFrame) -> DataFrame:
    """``key, right, left, id, pos, least, most`` of the suffixes of ``id, text``: words from there on, and backwards.

    ``least, most``: words to the left in the passages of MIN_WORDS words that the suffix stands for.
    """
    fields = [("key", T.LongType()), ("right", T.BinaryType()), ("left", T.BinaryType()), ("id", texts.schema["id"].dataType), ("pos", T.IntegerType()), ("least", T.IntegerType()), ("most", T.IntegerType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                (words,) = word_hashes([text or ""])
                raw = (words >> np.uint64(32)).astype(">u4")
                ahead, back = raw.tobytes(), raw[::-1].tobytes()
                for p, key, first, last in zip(*(x.tolist() for x in minimisers(words)), strict=True):
                    behind = len(ahead) - 4 * p
                    rows.append((key, ahead[4 * p : 4 * (p + MIN_WORDS)], back[behind : behind + 4 * (WINDOW - 1)], i, p, p - last, p - first))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)
        give_back()

    return texts.mapInPandas(of, schema)


def _common(column: list[bytes]) -> np.ndarray:
    """Words that each row's bytes share, from the first on, with those of the row before."""
    width = 4 * MIN_WORDS
    sizes = np.array([len(x) // 4 for x in column])
    words = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in column]), ">u4").reshape(-1, MIN_WORDS)
    differ = words[1:] != words[:-1]
    same = np.where(differ.any(1), differ.argmax(1), MIN_WORDS)
    return np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))



def _found_schema(suffixes: DataFrame) -> T.StructType:
    fields = [("id", suffixes.schema["id"].dataType), ("start", T.IntegerType()), ("end", T.IntegerType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _spans(ids: list, pos: np.ndarray, right: np.ndarray, left: np.ndarray) -> pd.DataFrame:
    """Rows for matches that are long enough."""
    keep = (right >= GRAM) & (right + left >= MIN_WORDS)
    return pd.DataFrame({"id": np.array(ids)[keep], "start": (pos - left)[keep].astype("int32"), "end": (pos + right)[keep].astype("int32")})


def _earlier_neighbours(suffixes: DataFrame) -> DataFrame:
    """Spans that a suffix shares with the nearest earlier one before it, and after it, in each task's sorted order.

    These two share more words with it, to the right, than any other earlier suffix of the task: what two suffixes
    share is the least that neighbours between them do. A stack holds the suffixes that can still be someone's nearest.
    """
    schema = _found_schema(suffixes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple] = []  # key of order, words shared with the entry below, words to the left
        last = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if last is None else pd.concat([last, batch], ignore_index=True)
            fresh = 0 if last is None else 1
            last = frame.iloc[-1:]
            key = frame["key"].to_numpy()
            shared = np.r_[0, np.where(key[1:] == key[:-1], _common(frame["right"].tolist()), 0)].tolist()
            pairs = []  # later suffix, its left words, the earlier one's left words, words shared to the right
            for i, (x, pos, words) in enumerate(zip(frame["id"].tolist(), frame["pos"].tolist(), frame["left"].tolist(), strict=True)):
                if i < fresh:
                    continue
                now, own = shared[i], (x, pos)
                if now < GRAM:
                    stack.clear()
                while stack and stack[-1][0] > own:
                    later, below, left = stack.pop()
                    pairs.append((*later, left, words, now))
                    now = min(now, below)
                if stack:
                    pairs.append((x, pos, words, stack[-1][2], now))
                if not (stack and now == MIN_WORDS and stack[-1][2] == words):  # else the earlier one stands for both
                    stack.append((own, now, words))
            if pairs:
                ids, pos, left, other, right = (list(c) for c in zip(*pairs, strict=True))
                yield _spans(ids, np.array(pos), np.array(right), _common([x for two in zip(other, left, strict=True) for x in two])[::2])
        give_back()

    return suffixes.mapInPandas(walk, schema)


_SPLITS = np.arange(WINDOW)


def _sums(column: list[bytes], weights: np.ndarray) -> np.ndarray:
    """64-bit sums over the first 0, 1, ... MIN_WORDS words of each row, weighted by place."""
    words = np.frombuffer(b"".join([x.ljust(4 * MIN_WORDS, b"\0") for x in column]), ">u4").reshape(-1, MIN_WORDS).astype(np.uint64)
    mixed = (words + np.uint64(1)) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * weights
    return np.concatenate([np.zeros((len(column), 1), np.uint64), mixed.cumsum(1, dtype=np.uint64)], 1)


def _windows(rows: pd.DataFrame, right: np.ndarray, left: np.ndarray) -> pd.DataFrame:
    """The passages of MIN_WORDS words that a suffix stands for and doesn't share with the first of its key.

    The passages of suffixes of one key are alike where key and hash are, with as many words to the left.
    """
    weights = np.random.default_rng(GRAM).integers(0, 2**63, (2, MIN_WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
    sum_right, sum_left = (_sums(rows[c].tolist(), w) for c, w in zip(("right", "left"), weights, strict=True))
    ahead = MIN_WORDS - _SPLITS
    there = (_SPLITS >= rows["least"].to_numpy()[:, None]) & (_SPLITS <= rows["most"].to_numpy()[:, None])
    row, split = np.nonzero(there & ~((_SPLITS <= left[:, None]) & (ahead <= right[:, None])))
    hashes = (sum_left[row, split] + sum_right[row, MIN_WORDS - split] + split.astype(np.uint64)) * _MIX
    start = (rows["pos"].to_numpy()[row] - split).astype("int32")
    return pd.DataFrame({"id": rows["id"].to_numpy()[row], "start": start, "end": start + np.int32(MIN_WORDS), "key": rows["key"].to_numpy()[row], "hash": (hashes ^ (hashes >> np.uint64(32))).view(np.int64)})


def _with_first(suffixes: DataFrame) -> DataFrame:
    """Spans that a suffix shares with the earliest of its key, and with any other, whichever tasks they are sorted into.

    A passage that a suffix shares with the first of its key is told by that. Its other passages of MIN_WORDS words are
    told where the same one, by hash, is found around an earlier suffix; of keys that two suffixes have there is none.
    """
    schema = T.StructType([*_found_schema(suffixes), T.StructField("key", T.LongType()), T.StructField("hash", T.LongType())])
    # Written, so that the join has two plain shuffles and Spark can split the key of a common passage.
    first = written(suffixes.groupBy("key").agg(F.min(F.struct("id", "pos", "right", "left")).alias("first"), F.count("*").alias("n")))
    both = suffixes.join(first, "key").where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.iloc[at : at + 4000]
                right, left = (_common([x for two in zip(part[f"first_{c}"], part[c], strict=True) for x in two])[::2] for c in ("right", "left"))
                yield _spans(part["id"].tolist(), part["pos"].to_numpy(), right, left).assign(key=None, hash=None)
                more = part["n"].to_numpy() > 2
                if more.any():
                    yield _windows(part[more], right[more], left[more])
        give_back()

    pairs = both.select("key", "n", "id", "pos", "right", "left", "least", "most", F.col("first.right").alias("first_right"), F.col("first.left").alias("first_left"))
    found = written(pairs.mapInPandas(compare, schema))
    windows = found.where("hash is not null")
    earliest = written(windows.groupBy("key", "hash").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = windows.join(earliest, ["key", "hash"]).where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    return found.where("hash is null").select("id", "start", "end").union(again.select("id", "start", "end"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` of documents with passages of MIN_WORDS words or more that occur before: spans of words.

    "Before" is a smaller id, or an earlier place in the same document. Words are lower-cased and cut at white space.
    Exact copies of a text are told as a whole and take no part in the search, but for the first of them.

    Defined cases: texts that are null, empty or of fewer than MIN_WORDS words have none; overlapping spans are
    joined; rows that repeat id and text are one document; rows of a null id take no part; texts of any length are
    read whole; other columns are never read; an empty table gives an empty result.
    """
    text = F.coalesce(q(text_col), F.lit(""))
    texts = in_small_batches(df).select(q(id_col).alias("id"), text.alias("text"), *_digest(text)).where(F.col("id").isNotNull())
    # Keys that occur in two texts, or twice in one: copies of one text don't make a key common.
    seen = _keys(texts.select("text", "text_a")).groupBy("key").agg(F.min("text_a").alias("a"), F.max("text_a").alias("b"), F.max("again").alias("again"))
    common = written(seen.where("a <> b or again").select("key"))
    firsts = written(texts.groupBy("text_a", "text_b").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    copies = written(texts.select("id", "text_a", "text_b").join(firsts, ["text_a", "text_b"]).where("id <> first_id").select("id").distinct())
    # Suffixes of other keys are left out as they are made; no text is shuffled to them, nor they to texts.
    all_of = told(_contexts(without(texts.select("id", "text"), copies, "id")), marked(common, "key"), [F.col("key")], "often")
    suffixes = written(all_of.where("often").drop("often").join(common, "key", "left_semi"))
    # Among suffixes alike to the right those with more to the left come first, so that they are met first.
    order = [F.asc("key"), F.asc("right"), F.desc("left"), F.asc("id"), F.asc("pos")]
    sorted_ones = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    later = _earlier_neighbours(sorted_ones).union(_with_first(suffixes)).select("id", "start", "end")
    n_words = F.regexp_count("text", F.lit(r"(?U)\S+")).cast("int")
    whole = told(texts.select("id", "text"), marked(copies, "id"), [F.col("id")], "often").where("often")
    whole = whole.select("id", F.lit(0).alias("start"), n_words.alias("end")).where(F.col("end") >= MIN_WORDS).join(copies, "id", "left_semi")
    return joined_spans(later.union(whole)).withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read_table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", words.cast("long").alias("n_words"), told_spans(F.col("spans")).alias("spans"))
