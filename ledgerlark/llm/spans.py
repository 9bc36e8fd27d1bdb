"""Spans of documents: joining those that touch, writing them, and cutting them out of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import fresh, q


def joined_spans(found: DataFrame) -> DataFrame:
    """``id, spans`` of rows ``id, start, end``: ascending, none touching. One shuffle by id; a document's rows are sorted, not held."""
    in_order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.select("id", "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("opens"))
    rows = rows.withColumn("n", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("id", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def told_spans(spans: Column) -> Column:
    """``start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def without_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the characters of each document's ``spans`` (columns ``id_col``, ``spans``) cut from its text."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is not None and own is not None:
                done, parts = 0, []
                for s in own:
                    parts.append(text[done : s["start"]])
                    done = s["end"]
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    key, found = fresh(df, "key", "spans")
    other = spans.select(q(id_col).alias(key), F.col("spans").alias(found))
    out = df.join(other, q(id_col) == q(key), "left")
    return out.select(*[cut(q(text_col), q(found)).alias(c) if c == text_col else q(c) for c in df.columns])
