"""Byte-level BPE, encoding and decoding, with a pair occurrence index.

The distinct chunks of a block of texts are laid out as one array of symbols with links to left and right. An index
maps each pair that some merge names to all its positions. Ranks that have positions are applied in ascending order:
one array operation merges every position of the pair, and only the pairs left and right of those positions are
looked up anew and filed in the index. Texts are then put together from their chunks.

Ascending order is right because a merge's product occurs only in later merges, so no applied rank can come back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .columns import fresh, in_small_batches, q
from .vocabulary import RecentCache, blocks, read_vocabulary, tokenizer, vocabulary_file

#: Characters that are tokenized together, and distinct chunks that a worker remembers.
BLOCK_CHARS, CACHED = 4_000_000, 150_000
#: A space before one of these opens a chunk; before other characters (a second space, a line's end) it may not.
_OPENS = "[!-~À-ɏ]"
_SPLIT = re.compile(f" (?={_OPENS})")
_IRREGULAR = re.compile(f" (?!{_OPENS})")
#: Chunks without these characters are cut by _PLAIN_WORDS, which is the byte-level pattern over those that remain; \\x00 ends a chunk.
_OTHER = re.compile("[^ -~\nÀ-ɏ]")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_WORDS = re.compile(rf"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s\x00{_L}0-9]+|[ \n]+(?![^ \n\x00])|[ \n]+")
_GAP, _DEAD = -1, -2


class PairIndexBPE:
    """A byte-level BPE vocabulary. Its merges must each make a symbol of their own, and their order be the rank."""

    def __init__(self, spec: str):
        self.library = tokenizer(spec)
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_ids = special
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(m)] for m in merges], np.int64)
        if len(set(made.tolist())) != len(made):
            raise ValueError("two merges make one symbol")
        self.base = len(vocab)
        codes = left * self.base + right
        order = np.argsort(codes)
        self.codes, self.ranks, self.left, self.right, self.made = codes[order], order, left, right, made
        # Bytes are written as characters: printable ones stand for themselves, the others follow from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.symbol = np.array([vocab[as_char[b]] for b in range(256)], np.int64)
        byte = {c: b for b, c in as_char.items()}
        self.bytes_of = {i: bytes(byte[c] for c in token) for token, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.symbol_or_gap = np.where(np.arange(256) < 2, _GAP, self.symbol)
        self.symbol_of = {c: int(self.symbol[b]) for c, b in byte.items()}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge names it. Negative symbols (gaps, merged places) have none."""
        codes = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], -1)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merges in place; gives the places, in order, that still hold an id.

        Words are apart by _GAP, which also begins and ends the array. A merged pair lives on in its left place.
        """
        n = len(symbols)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def file(positions: np.ndarray) -> None:
            ranks = self.rank_of(symbols[positions], symbols[right[positions]])
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if rank not in index:
                    heapq.heappush(active, rank)
                index[rank].append(some)

        file(np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            at = np.sort(np.concatenate(index.pop(rank)))
            at = at[np.r_[True, at[1:] != at[:-1]]]
            at = at[symbols[at] == a]
            at = at[symbols[right[at]] == b]
            if a == b and len(at) > 1:  # in a run of one symbol every other position merges, from the left
                fresh_run = np.r_[True, right[at[:-1]] != at[1:]]
                first = np.maximum.accumulate(np.where(fresh_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = right[at]
            symbols[at], symbols[gone] = self.made[rank], _DEAD
            right[at] = right[gone]
            left[right[at]] = at
            file(np.concatenate([left[at], at]))
        return np.flatnonzero(symbols >= 0)

    def first_symbols(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chunks' words, before any merge, and the chunk of each; words are apart by _GAP.

        Chunks of plain characters are cut in one go; others are cut by the library's own pre-tokenizer.
        """
        plain, other, cut, owner = [], [], [], []
        for i, chunk in enumerate(chunks):
            (other if _OTHER.search(chunk) or chunk in self.special_ids else plain).append(i)
        for i in other:
            chunk = chunks[i]
            words = [] if chunk in self.special_ids else self.library.pre_tokenizer.pre_tokenize_str(chunk)
            for word in [[self.symbol_of[c] for c in w] for w, _ in words] or [[self.special_ids[chunk]]]:
                cut += [*word, _GAP]
                owner += [i] * (len(word) + 1)
        marked = "\x01".join(_PLAIN_WORDS.findall("\x00".join([chunks[i] for i in plain]))).encode()
        found = np.frombuffer(marked, np.uint8)
        place = np.cumsum(found == 0)
        symbols = np.concatenate([[_GAP], self.symbol_or_gap[found], [_GAP], np.array(cut, np.int64)])
        at = np.array(plain, np.int64)[place] if plain else place
        return symbols.astype(np.int64), np.concatenate([[-1], at, [-1], np.array(owner, np.int64)]).astype(np.int64)

    def encode_chunks(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """Of each chunk: its ids in decimal, joined by commas, and what they decode to."""
        symbols, owners = self.first_symbols(chunks)
        kept = self.merge(symbols)
        symbols, owners = symbols[kept], owners[kept]
        order = np.argsort(owners, kind="stable")
        ends = np.searchsorted(owners[order], np.arange(len(chunks) + 1)).tolist()
        ids = symbols[order].tolist()
        shown, decoded = [self.decimal[x] for x in ids], [self.bytes_of[x] for x in ids]
        return [(",".join(shown[a:b]), b"".join(decoded[a:b])) for a, b in zip(ends, ends[1:], strict=False)]

    def chunks(self, text: str) -> list[str]:
        """``text`` cut where no word of the pre-tokenizer reaches across: at special tokens, and before single spaces."""
        if self.special is not None and "<" in text and self.special.search(text):
            found, done = [], 0
            for m in self.special.finditer(text):
                found += [*self.chunks(text[done : m.start()]), m[0]]
                done = m.end()
            return [*found, *self.chunks(text[done:])]
        if not text:
            return []
        parts = _SPLIT.split(text) if _IRREGULAR.search(text) else text.split(" ")
        first, rest = parts[0], [f" {p}" for p in parts[1:]]
        return [first, *rest] if first else rest


@lru_cache(2)
def _worker(spec: str) -> tuple[PairIndexBPE, RecentCache]:
    return PairIndexBPE(spec), RecentCache(CACHED)


def round_trips(texts: list[str], spec: str) -> Iterator[tuple[str, bytes]]:
    """Of each text: its ids in decimal, joined by commas, and the bytes of the text that they decode to."""
    bpe, cache = _worker(spec)
    for a, b in blocks(texts, BLOCK_CHARS):
        cut = [bpe.chunks(t) for t in texts[a:b]]
        known = cache.take(set().union(*cut), bpe.encode_chunks)
        for chunks in cut:
            found = [known[c] for c in chunks]
            yield ",".join([x[0] for x in found]), b"".join([x[1] for x in found]).decode("utf-8", "replace").encode()


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every row of ``df`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and ``decoded`` added.

    ``path`` is a byte-level BPE file of the tokenizers library. Names that ``df`` has get an underscore.

    Defined cases: a null text counts as empty; an empty text has no ids, and both digests are that of the empty
    string; special tokens in a text are that one id, as the library has it; texts of any length are encoded whole;
    an empty table gives an empty result.
    """
    spec = read_vocabulary(path or vocabulary_file("byte_bpe_50k.json"))
    shared = df.sparkSession.sparkContext.broadcast(spec)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids

    @F.pandas_udf(schema)
    def told_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for ids, decoded in round_trips([t or "" for t in texts], shared.value):
                row = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, ids, decoded.decode()) if with_ids else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    (told,) = fresh(df, "told")
    names = [c.split()[0] for c in schema.split(", ")]
    added = fresh(df, *names)
    out = in_small_batches(df).withColumn(told, told_of(q(text_col)))
    return out.select(*[q(c) for c in df.columns], *[q(told)[n].alias(a) for n, a in zip(names, added, strict=True)])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
