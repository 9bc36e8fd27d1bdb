"""The inbox as a stream: new messages are classified as their files come in, late repeats change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.classify import classify
from ..sources.inbox import EMAIL_SCHEMA


def stream_emails(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Message files of ``root``/inbox, each once, with the time that the file was written."""
    source = spark.readStream.schema(EMAIL_SCHEMA).option("multiLine", True).option("pathGlobFilter", "email_*.json").option("maxFilesPerTrigger", files_per_batch)
    return source.json(f"{root.rstrip('/')}/inbox").withColumn("arrived", F.col("_metadata.file_modification_time"))


def classified(emails: DataFrame, ask_send_as: str = "GENERAL") -> DataFrame:
    """Works on streams and tables alike. Attachments' kinds aren't known yet, so their names don't count."""
    found = classify(F.col("body"), F.col("subject"), F.size("attachments"), F.lit(None).cast("array<string>"), ask_send_as)
    return emails.withColumn("c", found).select("email_id", "subject", "arrived", "c.category", "c.confidence", "c.reason")


def category_counts(emails: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """``start, category, n`` per window of arrival; windows older than the watermark are closed."""
    rows = classified(emails).withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["email_id"])
    return rows.groupBy(F.window("arrived", width).alias("w"), "category").agg(F.count("*").alias("n")).select("w.start", "category", "n")


def write_classified(emails: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends classified messages as Parquet, and stops when all files that are there have been read."""
    once = classified(emails).withWatermark("arrived", "2 hours").dropDuplicatesWithinWatermark(["email_id"])
    return once.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
