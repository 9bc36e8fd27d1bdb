"""Likeness of two short texts: 200 times the longest common subsequence over both lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the usual table after the other."""
    left, right = F.split(a, ""), F.split(b, "")

    def row(before: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(F.when(F.element_at(right, j) == x, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, j)))),
            ),
        )

    table = F.aggregate(left, F.array_repeat(F.lit(0), F.length(b) + 1), row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def ratio(a: Column, b: Column) -> Column:
    """0 to 100; two empty texts are alike. Stays in the JVM; meant for the few pairs that a plain test leaves."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).when(total > 0, lcs_length(a, b) * F.lit(200.0) / total)


#: What squashed texts are made of, and how many of their letters a row of the table has as one number.
SQUASHED, BITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 62


def squashed_ratio(a: Column, b: Column) -> Column:
    """:func:`ratio` of squashed texts: a row of the table is one number (Hyyrö's bit-parallel form), so a letter of ``b`` is one step.

    A first text of more than 62 letters takes the plain table.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1
    backwards = F.reverse(a)

    def places(letter: Column) -> Column:
        """Bits where ``a`` has the letter, its first letter lowest."""
        at = F.instr(F.lit(SQUASHED), letter)
        digits = F.concat(F.repeat(F.lit("0"), at - 1), F.lit("1"), F.repeat(F.lit("0"), len(SQUASHED) - at))
        return F.conv(F.call_function("translate", backwards, F.lit(SQUASHED), digits), 2, 10).cast("long")

    masks = F.transform(F.split(b, ""), places)
    row = F.aggregate(masks, full, lambda s, m: (s + s.bitwiseAND(m)).bitwiseOR(s - s.bitwiseAND(m)).bitwiseAND(full))
    total = F.length(a) + F.length(b)
    return (
        F.when(a == b, F.lit(100.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when(F.length(a) <= BITS, (F.length(a) - F.bit_count(row)) * F.lit(200.0) / total)
        .otherwise(ratio(a, b))
    )


def lcs(a: str, b: str) -> int:
    """The same, with one integer as a row of the table (Hyyrö's bit-parallel form)."""
    place: dict[str, int] = {}
    for i, char in enumerate(a):
        place[char] = place.get(char, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & place.get(char, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def ratio_of(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows at its ends being cut short."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio_of(short, w) for w in windows if w)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_udf(a: Column, b: Column) -> Column:
    """:func:`ratio` for many long pairs: Arrow batches to the bit-parallel form."""
    return F.pandas_udf(_ratios, "double")(a, b)

