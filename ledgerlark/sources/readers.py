"""Attachments to lines: text in the JVM, packed formats in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IMAGE_EXTENSIONS
from ..functions.text import extension, html_to_text, split_lines
from ..operators.classify import detect_kind
from ..operators.layout import cluster_rows, row_lines
from .inbox import utf8_text
from .pdf import Broken, pdf_words

PACKED = "struct<fmt:string,lines:array<string>,passes:array<array<string>>,error:string,ocr:boolean>"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_BREAKS = re.compile(r"\s\|\s|;\s")


def docx_lines(data: bytes) -> list[str]:
    """Paragraphs that aren't empty, then each table row as ``label: first line`` with its other lines indented."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    text = lambda p: "".join(t.text or "" if t.tag == f"{_WORD}t" else "\n" if t.tag == f"{_WORD}br" else "\t" for t in p.iter() if t.tag in (f"{_WORD}t", f"{_WORD}br", f"{_WORD}tab"))
    lines = [t for p in body.findall(f"{_WORD}p") if (t := text(p)).strip()]
    for row in body.iterfind(f"{_WORD}tbl/{_WORD}tr"):
        cells = ["\n".join(text(p) for p in c.findall(f"{_WORD}p")) for c in row.findall(f"{_WORD}tc")]
        if len(cells) >= 2:
            first, *rest = cells[1].split("\n")
            lines += [f"{cells[0].strip()}: {first}", *[f"   {x}" for x in rest]]
    return lines


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")).strip()
    value = cell.findtext(f"{_SHEET}v") or ""
    return (shared[int(value)] if cell.get("t") == "s" and value else value).strip()


def xlsx_lines(data: bytes) -> list[str]:
    """Each row of each sheet: one cell as a line, more as ``label: value``, the value cut at bars and semicolons."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
    lines = []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for sheet in sheets:
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_SHEET}row"):
            cells = [v for c in row.findall(f"{_SHEET}c") if (v := _cell(c, shared))]
            if len(cells) > 1:
                parts = [p.strip() for p in _BREAKS.split(cells[1]) if p.strip()] or [""]
                lines += [f"{cells[0]}: {parts[0]}", *[f"   {p}" for p in parts[1:]]]
            else:
                lines += cells
    return lines


def read_packed(path: str, data: bytes) -> dict:
    """One attachment that isn't text; whatever goes wrong is told in ``error``."""
    ext = path.lower().rsplit(".", 1)[-1]
    lines, error, ocr, fmt = [], None, False, ext
    try:
        if ext == "docx":
            lines = docx_lines(data)
        elif ext in ("xlsx", "xlsm"):
            fmt, lines = "xlsx", xlsx_lines(data)
        elif ext in IMAGE_EXTENSIONS:
            fmt, error, ocr = "photo", "image could not be processed: no OCR engine is installed", True
        else:
            error = f"unsupported attachment type .{ext}"
    except Exception as e:  # noqa: BLE001  one bad file must not end the batch
        opened = {"docx": "Word file could not be opened", "xlsx": "Excel file could not be opened", "xlsm": "Excel file could not be opened"}
        error = f"{opened.get(ext, 'reader crashed')}: {e}"
    return {"fmt": fmt, "lines": lines, "passes": [], "error": error, "ocr": ocr}


def _packed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, contents in batches:
        yield pd.DataFrame([read_packed(p, bytes(c)) for p, c in zip(paths, contents, strict=True)], columns=["fmt", "lines", "passes", "error", "ocr"])


PAGES = "struct<pages:array<array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>,error:string>"
#: A text layer of fewer letters is that of a scan.
LEAST_LETTERS = 40


def _page_words(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for content in contents:
        data = bytes(content)
        try:
            pages, error = (pdf_words(data), None) if data.startswith(b"%PDF") else ([], "not a PDF (bad header)")
        except Broken:
            pages, error = [], "PDF could not be parsed (corrupt or truncated)"
        rows.append(([[dict(zip(("text", "x0", "y0", "x1", "y1"), w, strict=True)) for w in page] for page in pages], error))
    return pd.DataFrame(rows, columns=["pages", "error"])


def page_words(content: Column) -> Column:
    """``pages, error``: words with boxes of each page of a PDF file, or what is wrong with it."""
    return F.pandas_udf(_page_words, PAGES)(content)


def read_pdfs(files: DataFrame) -> DataFrame:
    """Rows ``email_id, pos, path, content`` of PDF files as documents: Python finds words, Spark their rows and lines.

    A page without a text layer is a scan, and told as one: no OCR engine is installed.
    """
    words = files.withColumn("w", page_words(F.col("content"))).select("email_id", "pos", "path", "w.*")
    lines = F.flatten(F.transform("pages", lambda page: row_lines(cluster_rows(page))))
    read = words.select("email_id", "pos", "path", "error", lines.alias("lines"))
    scan = F.col("error").isNull() & (F.length(F.regexp_replace(F.array_join("lines", ""), r"\s", "")) < LEAST_LETTERS)
    none = F.array().cast("array<string>")
    return read.select(
        "email_id", "pos", "path", F.when(scan, "pdf_scan").otherwise("pdf").alias("fmt"), F.when(scan, none).otherwise(F.coalesce("lines", none)).alias("lines"), F.array().cast("array<array<string>>").alias("passes"),
        F.when(scan, "OCR failed: no OCR engine is installed").otherwise(F.col("error")).alias("error"), scan.alias("ocr"),
    )


def read_documents(files: DataFrame) -> DataFrame:
    """``email_id, pos, path, fmt, kind, ocr, error, lines, passes`` of rows ``email_id, pos, path, content``.

    Text never leaves the JVM; only packed formats go to Python; a missing file is a document with an error.
    """
    files = files.withColumn("ext", extension(F.col("path")))
    none, no_passes = F.lit(None).cast("string"), F.array().cast("array<array<string>>")
    text = files.where("content is not null and ext = 'txt'").select("email_id", "pos", "path", F.lit("txt").alias("fmt"), split_lines(utf8_text(F.col("content"))).alias("lines"), no_passes.alias("passes"), none.alias("error"), F.lit(False).alias("ocr"))
    pdfs = read_pdfs(files.where("content is not null and ext = 'pdf'"))
    packed = files.where("content is not null and ext not in ('txt', 'pdf')").select("email_id", "pos", "path", F.pandas_udf(_packed, PACKED)("path", "content").alias("d")).select("email_id", "pos", "path", "d.*")
    missing = files.where("content is null").select("email_id", "pos", "path", F.col("ext").alias("fmt"), F.array().cast("array<string>").alias("lines"), no_passes.alias("passes"), F.lit("file could not be found").alias("error"), F.lit(False).alias("ocr"))
    docs = text.unionByName(pdfs).unionByName(packed).unionByName(missing)
    return docs.withColumn("kind", F.when(F.col("error").isNotNull(), "UNREADABLE").otherwise(detect_kind(F.col("lines"))))


MESSAGE = "struct<subject:string,from:string,to:string,body:string,html:string,attachments:array<struct<name:string,content:binary>>,error:string>"


def parse_message(name: str, data: bytes) -> dict:
    out = {"subject": "", "from": "", "to": "", "body": "", "html": None, "attachments": [], "error": None}
    if name.lower().endswith(".msg"):
        return out | {"error": ".msg files need the 'extract-msg' package. Or save the email as .eml and upload that."}
    try:
        message = message_from_bytes(data, policy=policy.default)
        part = message.get_body(preferencelist=("plain", "html"))
        if part is not None:
            out["html" if part.get_content_type() == "text/html" else "body"] = part.get_content()
        out |= {k: str(message[k] or "") for k in ("subject", "from", "to")}
        out["attachments"] = [{"name": n, "content": c} for p in message.iter_attachments() if (n := p.get_filename()) and (c := p.get_payload(decode=True))]
    except Exception as e:  # noqa: BLE001  one bad message must not end the batch
        out["error"] = f"email could not be parsed: {e}"
    return out


def _parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for names, contents in batches:
        yield pd.DataFrame([parse_message(n, bytes(c)) for n, c in zip(names, contents, strict=True)], columns=["subject", "from", "to", "body", "html", "attachments", "error"])


def read_messages(files: DataFrame) -> DataFrame:
    """``files`` (``name, content``) of .eml type with subject, from, to, body (from HTML where there is no text) and attachments."""
    out = files.withColumn("m", F.pandas_udf(_parsed, MESSAGE)("name", "content")).select(*files.columns, "m.*")
    body = F.when(F.col("html").isNotNull(), html_to_text(F.coalesce("html", F.lit("")))).otherwise(F.trim("body"))
    return out.withColumn("body", body).drop("html")
