"""A bitmap of keys, to tell early which rows of wide tables can't have any of them.

Each key sets one bit, chosen by its hash, of 2**BITS: 16 MB at most in pages of 4 KB, whatever the data, so it may
always be broadcast. A row whose bit isn't set has none of the keys and never moves. The rest are joined exactly, so
a bit that two keys share costs a row's journey and never changes a result. Texts of a hundred million rows that are
marked fill the bitmap; beyond that it spares less and less, and all else stays as it is: there is one plan only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .columns import fresh, q

BITS, PAGE = 27, 15


def _bit(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def marked(keys: DataFrame, *columns: str) -> DataFrame:
    """The bitmap of ``keys`` as written rows ``page, bits``."""
    bit = _bit([q(c) for c in columns])
    pages = keys.select(F.shiftright(bit, PAGE).alias("page"), bit.bitwiseAND(F.lit((1 << PAGE) - 1)).alias("bit"))
    return written(pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")))


def told(df: DataFrame, bitmap: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the bit of ``columns`` is set. Nothing of ``df`` is shuffled."""
    bit, page, bits = fresh(df, "bit", "page", "bits")
    pages = F.broadcast(bitmap.select(F.col("page").alias(page), F.col("bits").alias(bits)))
    out = df.withColumn(bit, _bit(columns)).withColumn(page, F.shiftright(q(bit), PAGE)).join(pages, page, "left")
    place = q(bit).bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(q(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    one = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place.bitwiseAND(F.lit(7)) + 1)
    is_set = F.coalesce(byte.bitwiseAND(one) > 0, F.lit(False))
    return out.select(*[q(c) for c in df.columns], is_set.alias(name))


def within(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``keys`` (of the same name, without repeats). Rows without a mark stay where they are."""
    (name,) = fresh(df, "marked")
    maybe = told(df, marked(keys, column), [q(column)], name).where(q(name)).drop(name)
    return maybe.join(keys.select(q(column)), [column], "left_semi").select(*[q(c) for c in df.columns])


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` isn't among ``keys``; a null stays.

    What moves of ``df``'s other columns are those rows alone that share a bit with a key by chance: rows with a mark
    are first looked up by ``column`` only, and those that stay after all are marked in their turn.
    """
    (name,) = fresh(df, "marked")
    flagged = told(df, marked(keys, column), [q(column)], name).withColumn(name, q(name) & q(column).isNotNull())
    chance = written(flagged.where(q(name)).select(q(column)).join(keys.select(q(column)), [column], "left_anti").distinct())
    stay = within(flagged.where(q(name)).drop(name), chance, column)
    return flagged.where(~q(name)).drop(name).unionAll(stay)
