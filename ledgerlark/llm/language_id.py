"""Language ID with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A trigram's vector binds its three letters' vectors, permuted by
place, by multiplication; a document bundles (sums) its trigrams' vectors; a language's prototype bundles the
documents of that language. A document's language is the prototype of the largest cosine.

A document's vector is linear in its trigram counts, so a batch of documents is one matrix of counts times one
matrix of trigram vectors. Learning sums vectors per language on the executors before anything is shuffled; what
comes to the driver is one vector per language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .columns import fresh, give_back, in_small_batches, q

DIM = 1024
SEED = 20240229
#: Characters and documents that are counted in one matrix; a longer document makes a matrix of its own.
BLOCK_CHARS, BLOCK_DOCS = 250_000, 256
#: Trigram vectors in memory at once.
BLOCK_GRAMS = 2048
#: Texts whose vectors are in memory at once.
AT_ONCE = 1024
#: Languages that a model may know; a prototype is DIM floats, so this bounds what the driver and tasks hold to 32 MB.
MAX_LANGUAGES = 8192
UNKNOWN = "und"
_SPACE = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter (the first, should there be several), or a space."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.int32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


@lru_cache(8192)  # of a KB each
def _letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, DIM, np.int8) * 2 - 1


def gram_vectors(symbols: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Vectors of trigrams; a code has three places of base ``len(symbols)``."""
    letters = np.stack([_letter_vector(int(s)) for s in symbols])
    n = len(symbols)
    once, twice = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    return (twice[codes // (n * n)] * once[codes // n % n] * letters[codes % n]).astype(np.float32)


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols; and for each (text, trigram) that occurs: the text's place, the trigram's code, its count.

    What isn't a letter is a space, runs of spaces are one, and a trigram's middle is a letter: so a word counts with
    its edges, and no trigram reaches from one word or text into the next.
    """
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    letters = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = letters != _SPACE
    keep[1:] |= letters[:-1] != _SPACE
    letters, owner = letters[keep], owner[keep]
    symbols, places = np.unique(np.concatenate([[_SPACE], letters, [_SPACE]]), return_inverse=True)
    n = len(symbols)
    codes = (places[:-2] * n + places[1:-1]) * n + places[2:]
    middle = letters != _SPACE
    keys, counts = np.unique(owner[middle] * n**3 + codes[middle], return_counts=True)
    return symbols, keys // n**3, keys % n**3, counts


def bundled(texts: list[str]) -> np.ndarray:
    """One row of DIM floats per text: the sum of its trigrams' vectors (zeros if it has no letter)."""
    out = np.zeros((len(texts), DIM), np.float32)
    start = 0
    while start < len(texts):
        end, chars = start + 1, len(texts[start])
        while end < len(texts) and end - start < BLOCK_DOCS and chars + len(texts[end]) <= BLOCK_CHARS:
            chars += len(texts[end])
            end += 1
        symbols, owner, codes, counts = count_grams(texts[start:end])
        grams, column = np.unique(codes, return_inverse=True)
        for at in range(0, len(grams), BLOCK_GRAMS):
            part = (column >= at) & (column < at + BLOCK_GRAMS)
            matrix = np.zeros((end - start, min(BLOCK_GRAMS, len(grams) - at)), np.float32)
            matrix[owner[part], column[part] - at] = counts[part]
            out[start:end] += matrix @ gram_vectors(symbols, grams[at : at + BLOCK_GRAMS])
        start = end
    return out


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves no remainder by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(q(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language of ``df``: the normalised sum of its documents' vectors.

    Defined cases: rows of a null text or language are left out, as are languages without a letter in any text; rows
    that repeat count as often as they occur; texts of any length are read whole; an empty table gives an empty
    model; more than MAX_LANGUAGES different labels are an error (a prototype of each comes to the driver).
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for a in range(0, len(texts), AT_ONCE):
                    vectors = bundled(texts.iloc[a : a + AT_ONCE].tolist()).sum(0, np.float64)
                    total[lang] = total[lang] + vectors if lang in total else vectors
        give_back()
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": [v.tolist() for v in total.values()]})

    rows = in_small_batches(df).select(q(lang_col).alias("lang"), q(text_col).alias("text")).dropna()
    vectors = rows.mapInPandas(sums, "lang string, vector array<double>").select("lang", array_to_vector("vector").alias("vector"))
    summed = vectors.groupBy("lang").agg(vector_to_array(Summarizer.sum(F.col("vector"))).alias("vector"))
    found = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = {r["lang"]: np.array(r["vector"], np.float64) for r in found}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(model.items()) if v.any()}


def judged(texts: pd.Series, prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the place of the best prototype (their number, where it has no letter) and the cosine, 0 if negative."""
    vectors = bundled([t or "" for t in texts])
    sizes = np.linalg.norm(vectors, axis=1)
    cosines = vectors @ prototypes.T / np.maximum(sizes, 1e-9)[:, None]
    cosines = np.concatenate([cosines, np.full((len(cosines), 1), -2.0)], 1)
    best = np.where(sizes > 0, cosines.argmax(1), len(prototypes))
    return best, np.clip(np.where(sizes > 0, cosines[np.arange(len(best)), best], 0), 0, 1)


def identify(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row of ``df`` with ``lang_pred, score`` added (renamed if ``df`` has such names); score is the cosine, 0 if negative.

    Defined cases: a text that is null or has no letter, and any text if the model is empty, gets ``und`` and 0; of
    equal cosines the first language by name wins; texts of any length are read whole; an empty table gives an empty
    result; other columns are never read.
    """
    names = np.array([*model, UNKNOWN], dtype=object)
    prototypes = np.stack([*model.values()]) if model else np.zeros((0, DIM), np.float32)
    shared = df.sparkSession.sparkContext.broadcast((names, prototypes))

    @F.pandas_udf("lang_pred string, score double")
    def told_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, prototypes = shared.value
        for texts in batches:
            found = [judged(texts.iloc[a : a + AT_ONCE], prototypes) for a in range(0, len(texts), AT_ONCE)]
            best, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
            yield pd.DataFrame({"lang_pred": names[best], "score": score.astype(float)})
        give_back()

    pred, score, told = fresh(df, "lang_pred", "score", "told")
    out = in_small_batches(df).withColumn(told, told_of(q(text_col)))
    return out.select(*[q(c) for c in df.columns], q(told)["lang_pred"].alias(pred), q(told)["score"].alias(score))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    model = learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
