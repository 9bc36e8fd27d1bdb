"""A table as one JSON document: an array of its rows, or one object by a key, in order.

Tasks write rows as lines of text, each with what stands before and after it; the driver then puts the part files
into one through the file system's own streams. No row is collected, and what the driver holds is a buffer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def with_ordinals(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """``df`` with each row's place, from 0 and without gaps, in the order of ``order``.

    Rows are dealt into ranges and sorted there; a range's places start after the rows of all ranges before it, whose
    counts (one number a range) come to the driver. No task sees more than its range.
    """
    at = F.monotonically_increasing_id()  # the range's number and the place within
    ranged = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]).withColumn(name, at))
    part, place = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    return ranged.withColumn(name, F.element_at(F.create_map(*starts), part) + place if starts else F.lit(0).cast("long"))


def _joined(spark: SparkSession, parts: str, target: str) -> None:
    """The files of a folder, in the order of their names, as one; the folder goes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    home = path(parts)
    fs = home.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(home) if x.getPath().getName().startswith("part-"))
    whole = path(f"{parts}/whole")
    out = fs.create(whole, True)
    try:
        for name in names:
            one = fs.open(path(f"{parts}/{name}"))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(one, out, conf, False)
            finally:
                one.close()
    finally:
        out.close()
    fs.delete(path(target), True)
    fs.rename(whole, path(target))
    fs.delete(home, True)


def write_lines(df: DataFrame, path: str) -> None:
    """Writes the column ``line`` of ``df`` to the file ``path``, in the order of ``ord``."""
    parts = f"{path}-{uuid.uuid4().hex}"
    df.repartitionByRange("ord").sortWithinPartitions("ord").select(F.col("line").alias("value")).write.text(parts)
    _joined(df.sparkSession, parts, path)


def write_json_document(df: DataFrame, path: str, order: list[str], key: str | None = None, hidden: tuple[str, ...] = ()) -> None:
    """Writes ``df`` to the file ``path``: an array of its rows as objects, or with ``key`` an object of the other columns by key.

    Nulls are written, ``hidden`` columns are not. Rows stand in the order of ``order``. An empty table is an empty array
    or object.
    """
    spark = df.sparkSession
    rows = with_ordinals(df, order)
    shown = [c for c in df.columns if c not in ("ord", key, *hidden)]
    body: Column = F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown]), {"ignoreNullFields": "false"})
    if key is not None:
        quoted = F.to_json(F.array(F.col(key).cast("string")))
        body = F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(": "), body)
    n = rows.count()
    opened, closed = ("[", "]") if key is None else ("{", "}")
    line = F.concat(F.when(F.col("ord") == 0, opened + "\n").otherwise(""), body, F.when(F.col("ord") == n - 1, "\n" + closed).otherwise(","))
    write_lines(rows.select("ord", line.alias("line")) if n else spark.createDataFrame([(0, opened + closed)], "ord long, line string"), path)
