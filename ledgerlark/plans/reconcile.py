"""The whole reconciliation: messages and documents in, one report row per message out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions.text import base_name
from ..operators import report as R
from ..operators.classify import classify, classify_upload
from ..operators.compare import RESULT_TYPE, compare_documents, roll_up, scanned_values, snapped, vocabulary
from ..operators.extract import FIELD_TYPE, extract
from ..sources.documents import with_ordinals, write_json_document, write_lines
from ..sources.inbox import attached_files, read_emails, read_files
from ..sources.readers import read_documents
from ..sources.shared import written


def _summaries(docs: DataFrame) -> DataFrame:
    """``email_id, documents``: what is told of each document, in the message's order. As many as it has attachments."""
    one = F.struct("pos", "path", F.col("fmt").alias("format"), "kind", "ocr", "error")
    return docs.groupBy("email_id").agg(F.array_sort(F.collect_list(one)).alias("documents"))


def guard(documents: Column) -> Column:
    """``review_reason, review_detail`` of a document set that can't be compared, null of one that can."""
    n = F.size(documents)
    bad = F.filter(documents, lambda d: d["error"].isNotNull())
    kinds = F.array_sort(F.transform(documents, lambda d: d["kind"]))
    told = lambda reason, detail: F.struct(F.lit(reason).alias("review_reason"), detail.alias("review_detail"))
    have = F.coalesce(F.get(documents, F.lit(0))["kind"], F.lit("nothing"))
    few = F.concat(F.lit("comparison needs an SI and a draft BL; only "), n.cast("string"), F.lit(" attachment(s) found ("), have, F.lit(")"))
    errors = F.array_join(F.transform(bad, lambda d: F.concat(base_name(d["path"]), F.lit(": "), d["error"])), "; ")
    types = F.concat(F.lit("expected one SI and one draft BL, got "), F.array_join(F.transform(documents, lambda d: F.concat(base_name(d["path"]), F.lit(" = "), d["kind"])), ", "))
    return (
        F.when(n < 2, told("missing_attachment", few))
        .when(F.size(bad) > 0, told("unreadable", errors))
        .when(kinds != F.array(F.lit("BL"), F.lit("SI")), told("wrong_doc_type", types))
    )


def prefill(documents: DataFrame) -> DataFrame:
    """``email_id, prefill``: values that were read so far, by side and field, for a person to complete."""
    sound = documents.where("error is null and kind in ('SI', 'BL')")
    values = F.transform_values(F.map_filter("fields", lambda k, f: ~f["blank"]), lambda k, f: f["raw"])
    return sound.groupBy("email_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("kind"), values.alias("values")))).alias("prefill"))


def reconcile(emails: DataFrame, docs: DataFrame, resolutions: DataFrame | None = None, ask_send_as: str = "GENERAL", upload: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """The report. ``docs`` as :func:`read_documents` gives them; ``resolutions`` as read by their reader; ``entries``: the
    vocabulary (see :func:`entries_of`) that names and places of scanned documents are snapped to, none by default.

    Shuffles by message: its documents' summaries, their fields, and what people decided. Where documents can't be
    compared, ``prefill`` has what was read of them. Of an upload for which a person entered all fourteen values these
    are compared, whatever its documents are.
    """
    if "broken" not in emails.columns:
        emails = emails.withColumn("broken", F.lit(None).cast("string"))
    emails = emails.join(_summaries(docs), "email_id", "left")
    documents = F.coalesce("documents", F.array().cast("array<struct<pos:int,path:string,format:string,kind:string,ocr:boolean,error:string>>"))
    kinds = F.transform(documents, lambda d: d["kind"])
    found = classify_upload(kinds) if upload else classify(F.col("body"), F.col("subject"), F.size("attachments"), kinds, ask_send_as)
    rows = emails.withColumn("documents", documents).withColumn("c", found).withColumn("stop", guard(documents))
    rows = rows.select("email_id", "from", "subject", "body", "attachments", "documents", "broken", "c.category", "c.confidence", F.col("c.reason").alias("reason"), "stop")

    ready = rows.where("category = 'BL_COMPARISON'").select("email_id")
    read = extract(docs.join(ready, "email_id", "left_semi"))
    side = F.struct("fields", "pass_fields", F.coalesce("ocr", F.lit(False)).alias("ocr"), "lines", "kind", "pos")
    pairs = read.groupBy("email_id").agg(*[F.max_by(F.when(F.col("kind") == k, side), F.when(F.col("kind") == k, F.lit(1))).alias(k.lower()) for k in ("SI", "BL")])
    rows = rows.join(pairs, "email_id", "left").join(prefill(read), "email_id", "left")
    decided = ["decision", "reviewer", "note"]
    if resolutions is not None:
        rows = rows.join(resolutions.withColumnRenamed("defect_fields", "decided_fields"), "email_id", "left")
        corrections = "corrections"
    else:
        rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in decided], F.lit(None).cast("array<string>").alias("decided_fields"))
        corrections = None
    manual = F.lit(False)
    if upload and corrections is not None:
        whole = lambda side: F.size(F.array_intersect(F.map_keys(F.col("corrections")[side]), F.array(*map(F.lit, FIELDS)))) == len(FIELDS)
        manual = (F.col("category") == "BL_COMPARISON") & F.coalesce(whole("si") & whole("bl"), F.lit(False))
    rows = rows.withColumn("manual", manual).withColumn("stop", F.when(~F.col("manual"), F.col("stop")))
    entered = lambda kind: F.struct(F.create_map().cast(f"map<string,{FIELD_TYPE}>").alias("fields"), F.lit(None).cast(f"array<map<string,{FIELD_TYPE}>>").alias("pass_fields"), F.lit(False).alias("ocr"), F.array().cast("array<string>").alias("lines"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("pos"))
    for kind in ("SI", "BL"):
        rows = rows.withColumn(kind.lower(), F.when(F.col("manual"), entered(kind)).when(F.col("stop").isNull(), F.col(kind.lower())))
    compared = F.col("si").isNotNull() & F.col("bl").isNotNull()
    if entries is not None:
        rows = rows.join(snapped(scanned_values(read, resolutions), entries), "email_id", "left")
    rows = compare_documents(rows, corrections, snaps=None if entries is None else "snaps")
    rows = rows.withColumn("fields", F.coalesce("fields", F.array().cast(f"array<{RESULT_TYPE}>")))
    rolled = roll_up(F.col("fields"), None if upload else F.col("si.ocr") | F.col("bl.ocr"))
    rows = rows.withColumn("r", F.when(compared, rolled))
    gated = F.col("category") == "BL_COMPARISON"
    by_person = gated & (F.coalesce("decision", F.lit("")) != "")
    touched = by_person | (gated & F.col("corrections").isNotNull()) if corrections is not None else by_person
    stopped = F.col("stop").isNotNull()
    failed, why = F.col("broken").isNotNull(), "the message file is not valid JSON"
    pick = lambda person, guard_value, rolled_value, failure=None: F.when(failed, failure).when(by_person, person).when(gated & stopped, guard_value).when(gated, rolled_value)
    none = F.array().cast("array<string>")
    return rows.select(
        "email_id", "from", "subject", "body", F.when(failed, "FAILED").otherwise("done").alias("processing"), F.when(failed, why).alias("error"), F.when(failed, "GENERAL").otherwise(F.col("category")).alias("category"), F.when(~failed, F.col("confidence")).alias("confidence"), F.when(~failed, F.col("reason")).alias("reason"),
        pick(F.col("decision"), F.lit("NEEDS_REVIEW"), F.col("r.status"), "NEEDS_REVIEW").alias("status"),
        pick(F.lit(None), F.col("stop.review_reason"), F.col("r.review_reason"), "unreadable").alias("review_reason"),
        pick(F.lit(None), F.col("stop.review_detail"), F.col("r.review_detail"), f"processing failed: {why}").alias("review_detail"),
        F.coalesce(pick(F.col("decision") == "MISMATCH", F.lit(False), F.col("r.has_defect")), F.lit(False)).alias("has_defect"),
        F.coalesce(pick(F.coalesce("decided_fields", none), none, F.col("r.defect_fields")), none).alias("defect_fields"),
        "fields", F.when(gated, F.col("documents")).otherwise(F.slice("documents", 1, 0)).alias("documents"),
        F.when(compared, F.col("si.pos") != 0).alias("swapped_attachment_order"),
        F.when(touched, F.coalesce("reviewer", F.lit("human"))).alias("resolved_by"), F.when(touched, F.col("note")).alias("resolution_note"),
        F.when(gated & stopped, F.col("prefill")).alias("prefill"), F.col("manual").alias("manual_entry"),
    )


def entries_of(docs: DataFrame) -> DataFrame:
    """Names and places that the inbox's own documents state, those of scans excepted."""
    return vocabulary(extract(docs.where("error is null and not ocr and kind in ('SI', 'BL')")))


def with_roles(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """``docs`` with the kind that a person gave a document (``email_id, path, role``) in place of the one found."""
    return docs.join(roles, ["email_id", "path"], "left").withColumn("kind", F.coalesce("role", "kind")).select(*docs.columns)


def reconcile_uploads(uploads: DataFrame, docs: DataFrame, roles: DataFrame | None = None, resolutions: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """The report of documents that came without a message: ``email_id`` names the upload, what it is about follows from their kinds."""
    none = F.lit(None).cast("array<string>")
    base = uploads.select("email_id", *[F.lit("").alias(c) for c in ("from", "subject", "body")], none.alias("attachments"))
    return reconcile(base, docs if roles is None else with_roles(docs, roles), resolutions, upload=True, entries=entries)


#: Columns of a report, as they are read again when some messages are retried.
REPORT_SCHEMA = (
    "email_id string, `from` string, subject string, body string, processing string, error string, category string, confidence double, reason string, status string, review_reason string, review_detail string, "
    f"has_defect boolean, defect_fields array<string>, fields array<{RESULT_TYPE}>, documents array<struct<pos:int,path:string,format:string,kind:string,ocr:boolean,error:string>>, "
    "swapped_attachment_order boolean, resolved_by string, resolution_note string, prefill map<string,map<string,string>>, manual_entry boolean"
)


def read_inbox(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Messages, their documents, and the vocabulary for scans among them (None where there is no readable scan)."""
    emails = read_emails(spark, root)
    # Stored, as files would be parsed again for the summaries, the fields and the vocabulary.
    docs = written(read_documents(attached_files(emails, read_files(spark, root))))
    scans = not docs.where("ocr and error is null").isEmpty()  # without any the vocabulary would be of no use
    return emails, docs, entries_of(docs) if scans else None


def reconcile_folder(spark: SparkSession, root: str, resolutions: DataFrame | None = None, ask_send_as: str = "GENERAL", prior: DataFrame | None = None, retry: list[str] | None = None) -> DataFrame:
    """The report of an inbox. With ``retry`` only of those messages, and of those that ``prior`` doesn't have, ``prior`` having the rest.

    Scans are snapped to what the whole inbox states, whatever is retried.
    """
    emails, docs, entries = read_inbox(spark, root)
    if prior is None or retry is None:
        return reconcile(emails, docs, resolutions, ask_send_as, entries=entries)
    again = retry_ids(emails, prior, retry)
    fresh = reconcile(again, docs.join(again.select("email_id"), "email_id", "left_semi"), resolutions, ask_send_as, entries=entries)
    return merged_report(emails, prior, fresh)


def retry_ids(emails: DataFrame, prior: DataFrame, asked: list[str]) -> DataFrame:
    """Messages to run again: those asked for, and those that the prior report doesn't have."""
    new = emails.join(prior.select("email_id"), "email_id", "left_anti")
    return emails.where(F.col("email_id").isin(asked)).unionByName(new).dropDuplicates(["email_id"])


def merged_report(emails: DataFrame, prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Prior rows with fresh ones in their place; rows of messages that the inbox no longer has drop out."""
    kept = prior.join(fresh.select("email_id"), "email_id", "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True).join(emails.select("email_id"), "email_id", "left_semi")


def write_outputs(report: DataFrame, folder: str, emails: DataFrame | None = None, resolutions: DataFrame | None = None) -> None:
    """``report.json`` and ``review_queue.json`` (arrays), ``submission.json`` (an object by message) and ``report.md``.

    All in the inbox's order: that of the files of ``emails``, or of ids without them. ``report`` should be stored.
    """
    folder = folder.rstrip("/")
    files = emails.select("email_id", "file") if emails is not None else report.select("email_id", F.col("email_id").alias("file"))
    ordered = with_ordinals(report.join(files.dropDuplicates(["email_id"]), "email_id", "left"), ["file", "email_id"], "place").drop("ord")
    order, hidden = ["file", "email_id"], ("file", "place")
    write_json_document(ordered.drop("body"), f"{folder}/report.json", order, hidden=hidden)
    write_json_document(R.review_queue(ordered, resolutions), f"{folder}/review_queue.json", order, hidden=hidden)
    write_json_document(R.submission(ordered), f"{folder}/submission.json", order, key="email_id", hidden=hidden)
    write_lines(R.report_lines(ordered), f"{folder}/report.md")
