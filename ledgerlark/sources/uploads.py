"""Files that people upload together: messages and loose documents, as one list of documents an upload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMAIL_EXTENSIONS
from ..functions.text import extension, html_to_text
from .inbox import unique_names
from .readers import parse_message
from .shared import written

PART = "part int, part_name string, part_content binary, subject string, sender string, recipient string, body string, html string, error string"


@F.udtf(returnType=PART)
class FileParts:
    """A message becomes a row for itself (part 0) and one for each file that it carries; any other file is its own part."""

    def eval(self, name: str, content: bytes, is_message: bool):
        if not is_message:
            yield (1, name, bytes(content), *[None] * 6)
            return
        m = parse_message(name, bytes(content))
        yield (0, None, None, m["subject"], m["from"], m["to"], m["body"], m["html"], m["error"])
        for n, a in enumerate(m["attachments"], 1):
            yield (n, a["name"], a["content"], *[None] * 6)


def read_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (``email_id, subject, from, to, body, error``) and documents (``email_id, pos, path, content``) of uploads.

    ``files``: ``upload_id, pos, name, content``; the upload's id is the ``email_id``. Of several messages of an upload the
    first counts, and the others are no documents. Documents stand in this order: what the message carries, then
    loose files as they came; equal names get numbers. A message that can't be parsed has an ``error`` and no files.
    """
    mail = extension(F.col("name")).isin(*EMAIL_EXTENSIONS)
    seen = files.withColumn("is_message", mail).withColumn("nth", F.row_number().over(Window.partitionBy("upload_id", "is_message").orderBy("pos")))
    kept = seen.where(~F.col("is_message") | (F.col("nth") == 1)).drop("nth")
    parts = kept.lateralJoin(FileParts(F.col("name").outer(), F.col("content").outer(), F.col("is_message").outer()))
    body = F.when(F.col("html").isNotNull(), html_to_text(F.coalesce("html", F.lit("")))).otherwise(F.trim("body"))
    messages = parts.where("part = 0").select(F.col("upload_id").alias("email_id"), "subject", F.col("sender").alias("from"), F.col("recipient").alias("to"), body.alias("body"), "error")
    order = F.row_number().over(Window.partitionBy("upload_id").orderBy(F.col("is_message").desc(), "pos", "part")) - 1
    # Stored: a message is parsed once, and only names go through the fold, not what the files hold.
    docs = written(parts.where("part > 0").select("upload_id", order.alias("pos"), F.col("part_name").alias("name"), F.col("part_content").alias("content")))
    named = unique_names(docs.select("upload_id", "pos", "name")).drop("name")
    return messages, docs.join(named, ["upload_id", "pos"]).select(F.col("upload_id").alias("email_id"), "pos", F.col("unique_name").alias("path"), "content")
