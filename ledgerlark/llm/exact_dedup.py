"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Three passes, each over fewer rows than the one before. Lengths come from the string header, prefix hashes are made
of rows whose length occurs twice, and whole texts are read for rows whose (length, prefix) occurs twice. What a pass
finds common is a bitmap of fixed size (see marks), so the next one sieves rows as they are read. What is shuffled is
keys, never texts, and every grouping is a sum or maximum that Spark combines before it shuffles, so a text that a
third of all rows repeat costs one key per task. The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import read_table
from .columns import ascii_lower, fresh, q
from .marks import marked, told

#: Characters of the prefix that the second level hashes.
PREFIX_CHARS = 256


def _text(text_col: str) -> Column:
    return F.coalesce(q(text_col), F.lit(""))


def _head(text_col: str, prefix_chars: int) -> Column:
    return F.xxhash64(ascii_lower(F.left(_text(text_col), F.lit(prefix_chars))))


def _sieves(df: DataFrame, text_col: str, prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """Bitmaps of the lengths that occur twice, and of the (length, prefix) that do."""
    rows = df.select(_text(text_col).alias("text"), F.octet_length(_text(text_col)).alias("size"))
    sizes = marked(rows.groupBy("size").count().where("count > 1"), "size")
    second = told(rows, sizes, [F.col("size")], "often").where("often").select("size", _head("text", prefix_chars).alias("prefix"))
    return sizes, marked(second.groupBy("size", "prefix").count().where("count > 1"), "size", "prefix")


def _sieved(df: DataFrame, sieves: tuple[DataFrame, DataFrame], text_col: str, prefix_chars: int) -> tuple[DataFrame, str]:
    """``df`` with a boolean: whether the row's length, and then its prefix too, is marked."""
    often, seen = fresh(df, "often", "seen")
    size = F.octet_length(_text(text_col))
    second = told(df, sieves[0], [size], often)
    # Of the rows that the lengths leave alone no prefix is hashed; it is null, and their second mark doesn't count.
    third = told(second, sieves[1], [size, F.when(q(often), _head(text_col, prefix_chars))], seen)
    return third.select(*[q(c) for c in df.columns], (q(seen) & q(often)).alias(seen)), seen


def survivors(df: DataFrame, sieves: tuple[DataFrame, DataFrame], id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``id, digest`` of the rows that length and prefix leave undecided, a few by chance among them; whole texts of these alone are read."""
    third, seen = _sieved(df.select(q(id_col).alias("id"), q(text_col).alias("text")), sieves, "text", prefix_chars)
    return third.where(q(seen)).select("id", F.sha2(ascii_lower(_text("text")), 256).alias("digest"))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of two rows or more with equal normalised text: ``digest, keep_id, group_size``."""
    groups = survivors(df, _sieves(df, text_col, prefix_chars), id_col, text_col, prefix_chars).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return written(groups.where("group_size > 1"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256``: one narrow row for every row of ``df``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays.

    Defined cases: a null text counts as empty; empty texts form one group; rows that repeat both id and text count
    in ``group_size`` and are kept together, as nothing tells them apart; a null id is kept only where all ids of
    its group are null; other columns are never read; an empty table gives an empty result.
    """
    groups = copies(df, id_col, text_col, prefix_chars)
    rows = df.select(q(id_col).alias("id"), F.sha2(ascii_lower(_text(text_col)), 256).alias("digest"))
    single = F.col("group_size").isNull()
    return rows.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each text, with the columns of ``df``: of rows that repeat the kept id too, any one.

    Rows that length and prefix tell apart stay where they are. Of the others, only those that are kept (and the few
    that share a bit with one) are shuffled, never the copies that go.

    Defined cases: those of :func:`exact_dedup`; clashing names don't matter.
    """
    one, digest, mark = fresh(df, "one", "digest", "mark")
    sieves = _sieves(df, text_col, PREFIX_CHARS)
    third, seen = _sieved(df, sieves, text_col, PREFIX_CHARS)
    stay = written(survivors(df, sieves, id_col, text_col, PREFIX_CHARS).groupBy("digest").agg(F.max("id").alias("one")).select(F.col("one").alias(one), F.col("digest").alias(digest)))
    rest = third.where(q(seen)).withColumn(digest, F.sha2(ascii_lower(_text(text_col)), 256))
    rest = told(rest, marked(stay, digest, one), [q(digest), q(id_col)], mark).where(q(mark))
    found = rest.join(stay, [digest]).where(q(id_col).eqNullSafe(q(one))).dropDuplicates([digest])
    return third.where(~q(seen)).select(*[q(c) for c in df.columns]).unionAll(found.select(*[q(c) for c in df.columns]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
