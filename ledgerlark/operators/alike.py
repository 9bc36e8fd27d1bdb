"""Pairs of alike texts by an inverted index of letter pairs.

Two texts of a likeness have so many letters in common, in order, that a number of their letter pairs must be the same:
each letter that one of them lacks breaks two pairs at most, one that it has besides one. So a value only needs to meet
entries that share one of its rarest pairs (as many as it may lack, and one), have a length that the likeness allows,
and turn out to share enough. All that is one equality join on length and pair; only what passes is scored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_udf
from ..functions.text import squash
from .dealing import once

#: Characters of squashed texts, and what stands before the first and after the last.
LETTERS, START, END = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "^", "$"
#: Below two thirds letters in common don't bind letter pairs any more.
LEAST = 70.0


def shared_least(total: Column | int, least: float) -> Column:
    """Letter pairs that two texts of ``total`` letters together must share to be ``least`` alike.

    With L letters in common, in order, ``total - 2 L`` are not: of the L + 1 pairs within them and their ends, as many
    can be broken.
    """
    return 3 * F.ceil(F.lit(total) * least / 200 if isinstance(total, int) else total * least / 200) - total + 1


def pair_ranks(entries: DataFrame) -> dict[str, int]:
    """Rank of every letter pair there can be, those that fewest entries have first. The alphabet bounds it: 1,444 at most come to the driver."""
    padded = F.concat(F.lit(START), squash(F.col("entry")), F.lit(END))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))
    found = {r["p"]: r["n"] for r in entries.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    possible = sorted((found.get(a + b, 0), a + b) for a in START + LETTERS for b in LETTERS + END)
    return {p: i for i, (_, p) in enumerate(possible)}


def ranked_pairs(text: Column, ranks: dict[str, int]) -> Column:
    """Numbers of a squashed text's letter pairs, rarest first; a pair's second occurrence has another number than its first."""

    @F.pandas_udf("array<long>")
    def numbered(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            padded, seen, own = START + (text or "") + END, Counter(), []
            for a, b in zip(padded, padded[1:], strict=False):
                own.append(ranks[a + b] << 32 | seen[a + b])
                seen[a + b] += 1
            out.append(sorted(own))
        return pd.Series(out, dtype=object)

    return numbered(text)


def candidate_pairs(values: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """``value, entry`` with their squashed texts ``a, b``: pairs that share as many letter pairs as a score of ``least`` needs, each once."""
    if least < LEAST:
        raise ValueError(f"a likeness of {LEAST} at least")
    ranks, reach = pair_ranks(entries), least / (200 - least)
    sizes = lambda n: F.sequence(F.greatest(F.ceil(n * reach), F.lit(1)), F.floor(n / reach))
    first = lambda pairs, n, needed: F.slice(pairs, F.lit(1), F.greatest(n + 2 - needed, F.lit(1)).cast("int"))
    a, b = F.length("a").cast("long"), F.length("b").cast("long")
    left = values.select("value", squash(F.col("value")).alias("a")).where("a <> ''").withColumn("pairs_a", ranked_pairs(F.col("a"), ranks))
    left = left.withColumn("size", F.explode(sizes(a))).withColumn("needed", shared_least(a + F.col("size"), least))
    # Outer, as for an inner one's filter Spark would number the pairs once more; a null meets nothing.
    left = left.withColumn("pair", F.explode_outer(first(F.col("pairs_a"), a, F.col("needed"))))
    right = entries.select("entry", squash(F.col("entry")).alias("b")).where("b <> ''").withColumn("pairs_b", ranked_pairs(F.col("b"), ranks))
    fewest = F.array_min(F.transform(sizes(b), lambda n: shared_least(b + n, least)))
    right = right.select("entry", "b", "pairs_b", b.alias("size"), F.explode_outer(first(F.col("pairs_b"), b, fewest)).alias("pair"))
    shared = F.array_intersect("pairs_a", "pairs_b")
    # The rarest pair that both have is among the first of both, so a pair of texts counts where it meets there.
    met = left.join(right, ["size", "pair"]).where((F.array_min(shared) == F.col("pair")) & (F.size(shared) >= F.col("needed")))
    return met.select("value", "entry", "a", "b")


def likely_pairs(values: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """``value, entry, score`` of the pairs whose squashed texts score ``least`` or more; distinct values and entries are expected."""
    pairs = candidate_pairs(values, entries, least)
    return once(pairs, "score", ratio_udf(F.col("a"), F.col("b"))).where(F.col("score") >= least).select("value", "entry", "score")
