"""What a dashboard shows of a report: totals, pages, items of one side, and small safe conversions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELDS

#: Characters of a subject and of a body that are shown.
SUBJECT_SHOWN, BODY_SHOWN = 70, 4000


def page_count(rows: Column, size: int) -> Column:
    """Pages that so many rows fill, one at least."""
    return F.greatest(F.ceil(rows / size), F.lit(1)).cast("int")


def page_shown(asked: Column, rows: Column, size: int) -> Column:
    """The page that is shown where ``asked`` is asked for: the nearest there is."""
    return F.least(F.greatest(asked, F.lit(1)), page_count(rows, size)).cast("int")


def totals(report: DataFrame) -> DataFrame:
    """One row: ``n`` messages in ``n_categories`` categories, of which ``n_failed`` failed."""
    return report.select(F.count("*").alias("n"), F.countDistinct("category").alias("n_categories"), F.count_if(F.col("processing") == "FAILED").alias("n_failed"))


def failed_ids(report: DataFrame) -> DataFrame:
    """``email_id`` of the messages that failed: a row each, however many they are."""
    return report.where(F.col("processing") == "FAILED").select("email_id")


def any_field(fields: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether something holds for one of a message's fields."""
    return F.coalesce(F.exists(fields, holds), F.lit(False))


def field_number(field: Column) -> Column:
    """The number that a field has on a page: its place among the seven, from 1."""
    return F.array_position(F.array(*map(F.lit, FIELDS)), field).cast("int")


def side_items(report: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """``keys, number, field, verdict, evidence, value`` of one side (si or bl): what can be marked on its pages."""
    items = report.select(*keys, F.inline_outer("fields")).where("field is not null")  # of an inner one Spark infers a filter, for which it would compare once more
    value, evidence = F.coalesce(F.col(side), F.lit("")), F.col(f"{side}_evidence")
    return items.where((value != "") | (evidence != "")).select(*keys, field_number(F.col("field")).alias("number"), "field", "verdict", evidence.alias("evidence"), value.alias("value"))


def short_texts(emails: DataFrame) -> DataFrame:
    """``emails`` with ``subject`` and ``body`` as much as is shown of them."""
    return emails.withColumn("subject", F.substring("subject", 1, SUBJECT_SHOWN)).withColumn("body", F.substring("body", 1, BODY_SHOWN))


def number_or(text: Column, default: float) -> Column:
    """A text as a number, or ``default`` where it is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))
