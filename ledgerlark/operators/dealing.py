"""Expressions that cost far more than their rows have bytes: dealt to all cores, and run once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a part where their number is told: what a task sorts stays the same, however many rows there are.
ROWS = 50_000


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` by ``keys``, in as many parts as the session shuffles into (or as there are cores), however few bytes they have.

    With ``rows``, about how many it has, in as many parts of :data:`ROWS` as these need, if that is more.

    Spark joins small shuffle parts by their bytes, which leaves a costly expression to a core or two; a number that is
    asked for stays. What follows by the same keys (a join, a group, a window) needs no shuffle of its own, so
    this takes the place of one wherever such a step comes next.
    """
    spark = df.sparkSession
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(own, spark.sparkContext.defaultParallelism, -(-rows // ROWS))
    # Of the session's own number Spark would take a shuffle by the same keys below this one in its place, and join that one's parts.
    parts += parts == own
    return df.repartition(parts, *keys)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as ``name``, which is evaluated once for each row, whatever filters and columns use it.

    Spark puts an expression in the place of its name in each filter that it pushes below it; it pushes none below a
    generator whose result the filter reads. An outer one, as Spark infers a filter from an inner one's input.
    """
    others = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != name]
    return df.select(*others, F.explode_outer(F.array(value)).alias(name))
