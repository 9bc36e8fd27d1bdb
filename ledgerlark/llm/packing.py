"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A task goes through its documents once: it encodes them, cuts whole windows off those that are longer than one, and
gathers what remains. A thousand remainders at a time are dealt into windows: each starts as a partition with one
filled window, and the two partitions of the largest imbalance merge, fullest window onto emptiest, until one is left.
Its windows are nearly equal, so if there are just enough of them, all are nearly full; if one is over capacity, the
number of windows rises. Nothing is shuffled: windows are numbered by task, and a task that is run again numbers alike.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q
from .vocabulary import RecentCache, blocks, read_vocabulary, tokenizer, vocabulary_file

WINDOW = 4096
END_ID = 2
#: Remainders that are dealt together: this many, or up to twice as many at a task's end.
GROUP = 1024
#: Characters that are encoded together, and distinct words that a worker remembers (twice that at most, some 200 bytes each).
BLOCK_CHARS, CACHED = 1_000_000, 200_000
#: Texts of plain characters are cut into the pre-tokenizer's words here, so that each distinct word is encoded once.
_OTHER = re.compile(r"[^\n\r\t -&(-~À-ÿ]")
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+")
_JOINED = 2000


def is_plain(text: str) -> bool:
    """Whether _WORDS cuts the text as the tokenizer does: usual characters alone, and nothing like a special token."""
    return not _OTHER.search(text) and "<|" not in text


class WordIds:
    """Ids by the tokenizers library, as little-endian 32-bit bytes; white space only separates words."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.library = tokenizer(spec)
        vocab = json.loads(spec)["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 3, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache = RecentCache(CACHED)
        self.others: set[str] = set()  # of a block's keys, those that aren't plain words

    def of_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Encodes many words as one text: a word's last symbol, and no other, is marked as a word's end."""
        found: list[bytes] = []
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                raw, at = ids.tobytes(), (4 * np.r_[0, cuts]).tolist()
                found += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                found += self.of_each(group)
        return found

    def of_keys(self, keys: list[str]) -> list[bytes]:
        others = [k for k in keys if k in self.others]
        apart = dict(zip(others, self.of_each(others), strict=True))
        words = iter(self.of_words([k for k in keys if k not in apart] if apart else keys))
        return [apart[k] if k in apart else next(words) for k in keys] if apart else list(words)

    def keys(self, text: str) -> list[str]:
        """Parts of ``text`` that are encoded apart: words where it is plain, else what stands between spaces."""
        if is_plain(text):
            return _WORDS.findall(text.lower())
        found = []
        for chunk in text.split(" "):
            if not is_plain(chunk):
                self.others.add(chunk)
                found.append(chunk)
            else:
                found += _WORDS.findall(chunk.lower())
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in blocks(texts, BLOCK_CHARS):
            self.others.clear()
            cut = [self.keys(t) for t in texts[a:b]]
            known = self.cache.take(set().union(*cut), self.of_keys)
            for keys in cut:
                yield b"".join(map(known.__getitem__, keys))


def differencing(sizes: list[int], windows: int) -> tuple[list[int], int]:
    """The window of each item by multiway differencing, and the fullest window's size."""
    # A partition: window sums, falling and less their least. A merge puts one's fullest window onto the other's emptiest.
    heap, made = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size if windows > 1 else 0, i, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        made.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), n + len(made) - 1, sums))
    places = {n + len(made) - 1: np.arange(windows)}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        slots = places.pop(n + k)
        of = np.empty(windows, np.int64)
        of[order] = slots  # window before sorting -> final window
        places[a], places[b] = of, of[::-1]
    window = [int(places[i][0]) for i in range(n)]
    return window, int(np.bincount(window, weights=sizes).max()) if n else 0


def pack(sizes: list[int], capacity: int = WINDOW) -> list[int]:
    """The window of each item, none over ``capacity``; sizes are at most that.

    Defined cases: no item gives no window; of equal sizes any may go first; items of size 0 take a place as well.
    """
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window, fullest = differencing(sizes, windows)
        if fullest <= capacity:
            return window
        windows += max(1, int(windows * (fullest / capacity - 1) / 2))


@lru_cache(2)
def _worker(spec: str) -> WordIds:
    return WordIds(spec)


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id_col``, then :data:`COLUMNS`. A sequence's pieces lie without gaps from offset 0.

    A document's ids are the tokenizer's, then ``end_id``. Those of ``window`` ids or more are cut at its multiples.

    Defined cases: a null or empty text is the single ``end_id``; rows that repeat an id are documents of their own;
    texts of any length are packed whole; other columns are never read; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or vocabulary_file("word_bpe_49k.json")))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COLUMNS]])
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _worker(shared.value)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def dealt(items: list[tuple]) -> list[tuple]:
            nonlocal sequence
            rows, filled = [], {}
            places = pack([x[2] for x in items], window)
            number = {w: sequence + i for i, w in enumerate(dict.fromkeys(places))}
            for item, w in zip(items, places, strict=True):
                rows.append((*item, number[w], filled.get(w, 0)))
                filled[w] = filled.get(w, 0) + item[2]
            sequence += len(number)
            return rows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({name: pd.Series(values, dtype=object if i == 0 else "int64") for i, (name, values) in enumerate(zip(schema.names, zip(*rows, strict=True), strict=True))})

        for batch in batches:
            rows = []
            keys = [None if pd.isna(k) else k for k in batch.iloc[:, 0]]
            for key, ids in zip(keys, words.encode([t or "" for t in batch.iloc[:, 1]]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    item = (key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                    if length == window:
                        rows.append((*item, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(item)
                if len(waiting) >= 2 * GROUP:
                    rows += dealt(waiting[:GROUP])
                    waiting = waiting[GROUP:]
            if rows:
                yield frame(rows)
        if waiting:
            yield frame(dealt(waiting))
        words.cache.settle()
        give_back()

    return in_small_batches(df).select(q(id_col), q(text_col)).mapInPandas(pieces, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
