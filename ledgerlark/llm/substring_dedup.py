"""Substring dedup by sliding sentence spans.

From every sentence on, and up to every sentence, the shortest run of several sentences is hashed: every two that
follow each other, and of a longer run every sentence is in such a pair, so whatever repeats is covered to both of its
ends. A caller may ask for runs of so many words at least; then it is the shortest run that has them. Texts are cut once, into a table of runs. Hashes meet globally in
a sum that Spark combines before it shuffles: how often each occurs, and where first. Those that occur again are
joined with the runs, and sentences that a run other than the first covers are removed.

A passage that a third of all documents share is one key in the sum; in the join Spark splits it over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import give_back, in_small_batches, q
from .marks import marked, told
from .spans import joined_spans, told_spans

#: A run has this many sentences and words at least. A sentence of more than MOST words is cut at clause marks, or every MOST words.
SENTENCES, WORDS, MOST = 2, 0, 25
#: Words of a run in the query: shorter ones are stock phrases that otherwise clean documents share (README has figures).
QUERY_WORDS = 15
_END = re.compile(r"(?<=[.!?])\s+|\n+")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")
_WORD = re.compile(r"\S+")


def _cut(text: str, start: int, end: int, mark: re.Pattern) -> list[tuple[int, int]]:
    found = []
    for m in mark.finditer(text, start, end):
        if m.start() > start:
            found.append((start, m.start()))
        start = m.end()
    return [*found, (start, end)] if start < end else found


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: they end at white space after ``.``, ``!`` or ``?``, and at line ends; long ones are cut into clauses."""
    found = []
    for a, b in _cut(text, 0, len(text), _END):
        if b - a < 2 * MOST or len(text[a:b].split()) <= MOST:
            found.append((a, b))
            continue
        for c, d in _cut(text, a, b, _CLAUSE):
            words = list(_WORD.finditer(text, c, d))
            found += [(words[i].start(), words[min(i + MOST, len(words)) - 1].end()) for i in range(0, len(words), MOST)]
    return found


def shortest_runs(sizes: list[int], min_sentences: int = SENTENCES, min_words: int = WORDS) -> set[tuple[int, int]]:
    """First and last sentence of the shortest run that is long enough, from each sentence on and up to each sentence."""

    def ends(sizes: list[int]) -> Iterator[tuple[int, int]]:
        start = total = 0
        for end, size in enumerate(sizes):
            total += size
            while end - start >= min_sentences and total - sizes[start] >= min_words:
                total -= sizes[start]
                start += 1
            if end - start + 1 >= min_sentences and total >= min_words:
                yield start, end

    last = len(sizes) - 1
    return {*ends(sizes), *((last - j, last - i) for i, j in ends(sizes[::-1]))}


def runs(text: str, min_sentences: int = SENTENCES, min_words: int = WORDS) -> list[tuple[int, int, bytes]]:
    """Start, end and 128-bit hash of each of those runs. Case and the kind of white space don't count."""
    spans = sentences(text)
    parts = [" ".join(text[a:b].lower().split()) for a, b in spans]
    chosen = shortest_runs([p.count(" ") + 1 if p else 0 for p in parts], min_sentences, min_words)
    return [(spans[i][0], spans[j][1], xxhash.xxh3_128_digest("\n".join(parts[i : j + 1]).encode("utf-8", "surrogatepass"))) for i, j in sorted(chosen)]


def sentence_runs(df: DataFrame, id_col: str, text_col: str, min_sentences: int = SENTENCES, min_words: int = WORDS) -> DataFrame:
    """Rows ``high, low`` (the hash), ``id, start, end`` of every run."""
    fields = [("high", T.LongType()), ("low", T.LongType()), ("id", df.schema[id_col].dataType), ("start", T.IntegerType()), ("end", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, owner, starts, ends = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = runs(text or "", min_sentences, min_words)
                    owner += [i] * len(found)
                    for a, b, digest in found:
                        starts.append(a)
                        ends.append(b)
                        hashes.append(digest)
                pairs = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pa.py_buffer(b"".join(hashes))]) if hashes else pa.array([], pa.int64())
                columns = [pairs.take(pa.array(range(k, 2 * len(hashes), 2), pa.int64())) for k in (0, 1)]
                columns += [part.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return df.select(q(id_col), q(text_col)).mapInArrow(cut, schema)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = SENTENCES, min_words: int = WORDS) -> DataFrame:
    """``id_col, spans`` of the documents that lose text: spans of characters, ascending, none touching.

    The first of equal runs is that of the smallest id, then of the smallest start; it stays.

    Defined cases: null, empty and short texts have no run; a run that occurs again within its document counts; rows
    that repeat id and text are one document; a null id comes before all others; texts of any length are read whole;
    other columns are never read; an empty table gives an empty result.
    """
    cut = written(sentence_runs(in_small_batches(df), id_col, text_col, min_sentences, min_words))
    first = F.min(F.struct(F.col("id").alias("first_id"), F.col("start").alias("first_start"))).alias("first")
    counted = cut.groupBy("high", "low").agg(F.count("*").alias("n"), first)
    again = written(counted.where("n > 1").select("high", "low", "first"))
    found = told(cut, marked(again, "high"), [F.col("high")], "often").where("often").drop("often").join(again, ["high", "low"])
    same = F.col("id").eqNullSafe(F.col("first.first_id")) & (F.col("start") == F.col("first.first_start"))
    return joined_spans(found.where(~same)).withColumnRenamed("id", id_col)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read_table(spark, sf_dir, "documents"), min_words=QUERY_WORDS)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", removed.cast("long").alias("n_removed"), told_spans(F.col("spans")).alias("spans"))
