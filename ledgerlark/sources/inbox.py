"""Messages, their attachments, and what people decided about them, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL_SCHEMA = "email_id string, `from` string, subject string, body string, attachments array<string>"
RESOLUTION_SCHEMA = "map<string,struct<decision:string,defect_fields:array<string>,corrections:struct<si:map<string,string>,bl:map<string,string>>,reviewer:string,note:string>>"


def read_emails(spark: SparkSession, root: str) -> DataFrame:
    """One row per message file of ``root``/inbox, with the file's name: the inbox's order is that of ``file``.

    A directory with a filter, as a glob would list every file apart. A file that isn't such a message keeps its text in ``broken``, and its name as its id.
    """
    files = spark.read.schema(f"{EMAIL_SCHEMA}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "email_*.json")
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)
    return files.json(f"{root.rstrip('/')}/inbox").withColumn("email_id", F.coalesce("email_id", name)).withColumn("file", F.col("_metadata.file_name"))


def attachments(emails: DataFrame) -> DataFrame:
    """``email_id, pos, path``: one row per attachment, in the message's order."""
    return emails.select("email_id", F.posexplode("attachments").alias("pos", "path"))


def read_files(spark: SparkSession, root: str, folder: str = "attachments") -> DataFrame:
    """``path`` (relative to ``root``), ``content``, of all files of a folder."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{folder}")
    start = F.instr(F.col("path"), f"{root}/") + len(root) + 1
    return files.select(F.substring(F.col("path"), start, F.lit(1 << 20)).alias("path"), "content")


def attached_files(emails: DataFrame, files: DataFrame) -> DataFrame:
    """``email_id, pos, path, content``; a file that is missing has a null content, and stays a row."""
    return attachments(emails).join(files, "path", "left").select("email_id", "pos", "path", "content")


def utf8_text(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """``email_id, decision, defect_fields, corrections, reviewer, note`` of a JSON object by message; unreadable: empty."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", RESOLUTION_SCHEMA)).alias("email_id", "r")).select("email_id", "r.*")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a report file, be it a list of objects or an object by message id."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{schema}>>")
    keyed = F.from_json("value", f"map<string,struct<{schema}>>")
    as_list = text.where(F.col("value").rlike(r"^\s*\[")).select(F.inline(listed))
    as_map = text.where(F.col("value").rlike(r"^\s*\{")).select(F.explode(keyed).alias("email_id", "r"))
    names = [c for c in as_list.columns if c != "email_id"]
    return as_list.unionByName(as_map.select("email_id", *[F.col("r")[c].alias(c) for c in names]))


def read_template(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a sample submission, an object by message: what a submission has to look like."""
    return read_report(spark, path, f"email_id:string,{schema}")


def read_first_report(spark: SparkSession, folders: list[str], schema: str, name: str = "report.json") -> DataFrame:
    """The report of the first folder that has one, as where a run's own takes the place of a sample; empty without any."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return read_report(spark, path.toString(), schema)
    return spark.createDataFrame([], schema)


def unique_names(files: DataFrame, key: str = "upload_id") -> DataFrame:
    """Rows ``key, pos, name`` with ``unique_name``: the second file of a name gets ``_2`` before its extension, and so on.

    Names are given in the order of ``pos``, one upload after the other, and a task remembers those it has given in the
    upload it is in; a number that would make a name given before is left out. So no two files of an upload share one.
    """
    names = [*files.columns, "unique_name"]
    schema = T.StructType([*files.schema, T.StructField("unique_name", T.StringType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upload, given, next_ = object(), set(), {}
        for batch in batches:
            out = []
            for own, name in zip(batch[key], batch["name"], strict=True):
                if own != upload:
                    upload, given, next_ = own, set(), {}
                made, n = name, next_.get(name, 1)
                stem, dot, ext = name.rpartition(".")
                while made in given:
                    n += 1
                    made = f"{stem or name}_{n}.{ext}" if dot and ext else f"{name}_{n}"
                next_[name] = n
                given.add(made)
                out.append(made)
            yield batch.assign(unique_name=out)[names]

    return files.repartition(key).sortWithinPartitions(key, "pos").mapInPandas(fold, schema)
