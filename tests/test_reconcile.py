"""The whole reconciliation on a small inbox, and its parts."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import compare as M
from ledgerlark.operators import extract as E
from ledgerlark.operators import dealing, layout, quality
from ledgerlark.operators import report as R
from ledgerlark.plans import reconcile as P
from ledgerlark.sources import inbox as I
from ledgerlark.sources import readers
from ledgerlark.streaming import inbox as stream

SI = """SHIPPING INSTRUCTION
====================
Shipper (Principal or Seller): ALFA PAPER CO., LTD
  12 HARBOUR ROAD
Consignee (Non-Negotiable): EAST BRIGHT FZ-LLC
Notify Party: BETA TRADING
  ON BEHALF OF GAMMA
Port of Loading (POL): BUSAN (KRPUS), KOREA
POD: PORT KLANG, MALAYSIA
No. of Containers: 6 x 40'HC
Gross Weight毛重(KGS): 131,058 KG
NET WEIGHT: 1 KG
"""
BL = """BILL OF LADING (DRAFT)
Shipper: Alfa Paper Company Limited
To the Order of: East Bright FZ LLC
Notify: Beta Trading
Load Port: Pusan, South Korea
Discharge Port: Port Kelang
Container Count: SIX
Gross Wt (kgs): 131.058 MT
"""


def docx(lines, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = lambda row: "".join(f"<w:tc>{''.join(map(para, c.split(chr(10))))}</w:tc>" for c in row)
    body = "".join(map(para, lines)) + "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx(rows):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = lambda row: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in row)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


CASES = {
    "email_01": ([SI, BL], "OK", None, []),
    "email_02": ([BL.replace("SIX", "7"), SI], "MISMATCH", None, ["container_count"]),
    "email_03": ([SI], "NEEDS_REVIEW", "missing_attachment", []),
    "email_04": ([SI, BL.replace("SIX", "TBA")], "NEEDS_REVIEW", "missing_value", []),
    "email_05": ([SI, "PACKING LIST\n"], "NEEDS_REVIEW", "wrong_doc_type", []),
    "email_06": ([SI, None], "NEEDS_REVIEW", "unreadable", []),
    "email_07": ([SI, BL.replace("Beta Trading", "Beta Trading\n  on behalf of Delta").replace("SIX", "N/A")], "MISMATCH", None, ["notify_party"]),
    "email_08": ([], None, None, []),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    (root / "inbox").mkdir()
    (root / "attachments").mkdir()
    for key, (texts, *_) in CASES.items():
        paths = []
        for i, text in enumerate(texts):
            paths.append(f"attachments/{key}_{i}.txt")
            if text is not None:
                (root / paths[-1]).write_text(text)
        body = "WARNING: This email originated outside.\n\nPlease see the invoice" if key == "email_08" else "hello\nBest regards,\nanna lee"
        (root / "inbox" / f"{key}.json").write_text(json.dumps({"email_id": key, "from": "a@b.example", "subject": f"RE: {key}", "body": body, "attachments": paths}))
    return root


@pytest.fixture(scope="module")
def report(spark, folder):
    return P.reconcile_folder(spark, str(folder)).cache()


def test_statuses(report):
    got = {r.email_id: (r.status, r.review_reason, r.defect_fields) for r in report.collect()}
    assert got == {k: tuple(v[1:]) for k, v in CASES.items()}


def test_details(report):
    rows = {r.email_id: r for r in report.collect()}
    assert rows["email_02"].swapped_attachment_order and not rows["email_01"].swapped_attachment_order
    assert rows["email_04"].review_detail == "container_count: BL value is blank/placeholder ('TBA')"
    assert rows["email_07"].review_detail.startswith("also needs a person: container_count (BL value")
    assert rows["email_07"].fields[2].reason == "'on behalf of' party differs (GAMMA vs DELTA)"
    assert rows["email_02"].fields[5].reason == "6 vs 7"
    assert rows["email_08"].category == "INVOICE_QUERY" and rows["email_08"].fields == []
    assert rows["email_06"].review_detail == "email_06_1.txt: file could not be found"


def test_a_broken_message_is_told(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "in")
    (tmp_path / "in/inbox/email_99.json").write_text("{not json")
    got = {r.email_id: r for r in P.reconcile_folder(spark, str(tmp_path / "in")).collect()}
    bad = got.pop("email_99")
    assert (bad.processing, bad.category, bad.status, bad.review_reason, bad.has_defect) == ("FAILED", "GENERAL", "NEEDS_REVIEW", "unreadable", False)
    assert bad.error in bad.review_detail
    assert {k: r.status for k, r in got.items()} == {k: v[1] for k, v in CASES.items()}
    assert all(r.processing == "done" for r in got.values())


def test_uploads(spark):
    docs = [("two", 0, "BL.txt", BL.replace("SIX", "7")), ("two", 1, "SI.txt", SI), ("one", 0, "SI.txt", SI), ("role", 0, "a.txt", "NOTE\n" + SI.split("\n", 1)[1]), ("role", 1, "b.txt", BL)]
    files = spark.createDataFrame([(i, p, n, bytearray(t.encode())) for i, p, n, t in docs], "email_id string, pos int, path string, content binary")
    uploads = spark.createDataFrame([("two",), ("one",), ("role",), ("none",)], "email_id string")
    roles = spark.createDataFrame([("role", "a.txt", "SI")], "email_id string, path string, role string")
    got = {r.email_id: r for r in P.reconcile_uploads(uploads, readers.read_documents(files), roles).collect()}
    assert {k: (r.category, r.status, r.review_reason) for k, r in got.items()} == {
        "two": ("BL_COMPARISON", "MISMATCH", None),
        "one": ("BL_COMPARISON", "NEEDS_REVIEW", "missing_attachment"),
        "role": ("BL_COMPARISON", "OK", None),
        "none": ("GENERAL", None, None),
    }
    assert got["two"].swapped_attachment_order and got["two"].defect_fields == ["container_count"]


def test_decisions_and_corrections(spark, folder, tmp_path):
    told = {"email_03": {"decision": "OK", "reviewer": "kim", "note": "phoned"}, "email_04": {"corrections": {"bl": {"container_count": "6"}}, "note": "asked"}, "email_05": {"decision": "MISMATCH", "defect_fields": ["shipper"]}}
    (tmp_path / "r.json").write_text(json.dumps(told))
    got = {r.email_id: r for r in P.reconcile_folder(spark, str(folder), I.read_resolutions(spark, str(tmp_path / "r.json"))).collect()}
    assert (got["email_03"].status, got["email_03"].resolved_by, got["email_03"].review_reason) == ("OK", "kim", None)
    assert (got["email_04"].status, got["email_04"].resolved_by) == ("OK", "human")
    assert got["email_04"].fields[5].bl_evidence == "human-entered: 6"
    assert (got["email_05"].status, got["email_05"].defect_fields, got["email_05"].has_defect) == ("MISMATCH", ["shipper"], True)
    (tmp_path / "bad.json").write_text("not json")
    assert I.read_resolutions(spark, str(tmp_path / "bad.json")).count() == 0


def test_outputs(spark, report, tmp_path):
    P.write_outputs(report, str(tmp_path))
    read = lambda name: json.loads((tmp_path / name).read_text())
    assert [r["email_id"] for r in read("report.json")] == sorted(CASES)
    assert [r["email_id"] for r in read("review_queue.json")] == [k for k, v in sorted(CASES.items()) if v[1] == "NEEDS_REVIEW"]
    told = read("submission.json")
    assert list(told) == sorted(CASES) and told["email_02"] == {"category": "BL_COMPARISON", "status": "MISMATCH", "review_reason": None, "defect_fields": ["container_count"], "has_defect": True}
    lines = (tmp_path / "report.md").read_text().split("\n")
    assert "BL_COMPARISON: 7, INVOICE_QUERY: 1" in lines and [x.split(" | ")[0] for x in lines if x.startswith("| email_")] == [f"| {k}" for k in sorted(CASES) if k != "email_08"]
    again = I.read_report(spark, str(tmp_path / "report.json"), P.REPORT_SCHEMA)
    assert again.schema.simpleString() == report.schema.simpleString()
    assert {r.email_id: r.status for r in again.collect()} == {r.email_id: r.status for r in report.collect()}


def test_order_is_that_of_files(spark, report, tmp_path):
    files = spark.createDataFrame([(k, f"email_{99 - int(k[-2:])}.json") for k in CASES], "email_id string, file string")
    P.write_outputs(report, str(tmp_path), files)
    assert [r["email_id"] for r in json.loads((tmp_path / "report.json").read_text())] == sorted(CASES, reverse=True)


def test_what_was_read_waits_for_a_person(report):
    rows = {r.email_id: r.prefill for r in report.collect()}
    assert rows["email_03"]["si"]["gross_weight_kg"] == "131,058 KG" and "bl" not in rows["email_03"]
    assert rows["email_05"]["si"]["shipper"] == "ALFA PAPER CO., LTD" and rows["email_01"] is None and rows["email_08"] is None


def test_fourteen_values_need_no_documents(spark):
    values = {"shipper": "A LTD", "consignee": "B", "notify_party": "C", "port_of_loading": "BUSAN", "port_of_discharge": "KLANG", "container_count": "2", "gross_weight_kg": "5 KG"}
    docs = [("one", 0, "SI.txt", SI), ("part", 0, "SI.txt", SI), ("bad", 0, "x.zip", "x"), ("bad", 1, "y.zip", "y")]
    files = spark.createDataFrame([(i, p, n, bytearray(t.encode())) for i, p, n, t in docs], "email_id string, pos int, path string, content binary")
    side = "map<string,string>"
    told = [("one", values, {**values, "container_count": "3"}), ("part", values, {"shipper": "A LTD"}), ("bad", values, values)]
    told = spark.createDataFrame([(i, None, None, None, None, (a, b)) for i, a, b in told], f"email_id string, decision string, reviewer string, note string, defect_fields array<string>, corrections struct<si:{side},bl:{side}>")
    got = {r.email_id: r for r in P.reconcile_uploads(spark.createDataFrame([("one",), ("part",), ("bad",)], "email_id string"), readers.read_documents(files), resolutions=told).collect()}
    assert {k: (r.status, r.review_reason, r.defect_fields, r.manual_entry) for k, r in got.items()} == {"one": ("MISMATCH", None, ["container_count"], True), "part": ("NEEDS_REVIEW", "missing_attachment", [], False), "bad": ("OK", None, [], True)}
    assert got["one"].fields[5].si_evidence == "human-entered: 2"


def test_queue_has_what_was_saved(spark, report):
    saved = spark.createDataFrame([("email_03", "OK", "phoned")], "email_id string, decision string, note string")
    got = {r.email_id: (r.saved_decision, r.saved_note) for r in R.review_queue(report, saved).collect()}
    assert got["email_03"] == ("OK", "phoned") and got["email_04"] == (None, None)


def test_replies(report):
    reply = R.draft_reply(F.col("from"), F.col("subject"), F.col("body"), F.col("status"), F.col("review_reason"), F.col("review_detail"), F.col("fields"))
    got = {r.email_id: r.reply for r in report.select("email_id", reply.alias("reply")).collect()}
    assert got["email_01"].kind == "ok" and got["email_01"].body.startswith("Hi Anna,\n\nMany thanks")
    assert "in 1 field, listed" in got["email_02"].body and "Container count   6 x 40'HC   7" in got["email_02"].body
    assert got["email_04"].kind == "missing_value" and "Container count is left open on the draft BL (TBA)" in got["email_04"].body
    assert got["email_08"] is None and got["email_03"].subject == "RE: email_03"


def test_retry_and_merge(spark, report):
    emails = report.select("email_id")
    prior = report.where("email_id <> 'email_01'").select("email_id", F.lit("old").alias("status"))
    assert sorted(r.email_id for r in P.retry_ids(emails, prior, ["email_02"]).collect()) == ["email_01", "email_02"]
    fresh = report.where("email_id in ('email_01', 'email_02')").select("email_id", F.lit("new").alias("status"))
    got = {r.email_id: r.status for r in P.merged_report(emails, prior, fresh).collect()}
    assert got == {k: "new" if k in ("email_01", "email_02") else "old" for k in CASES}


def fields(spark, text, ocr=False):
    df = spark.createDataFrame([("e", 0, text.split("\n"), ocr, None)], "email_id string, pos int, lines array<string>, ocr boolean, passes array<array<string>>")
    return E.extract(df).first().fields


def test_extraction(spark):
    got = fields(spark, "Shipper:\n  STREET 1\nConsignee\n  WRAPPED LTD\n  TOWN\nNotify Party: N/A\n  ignored\nGross Weight: 5 KG\nGross Weight: 6 KG\nPOL: A\n  POD: B\nNet Weight: 9")
    assert (got["shipper"].raw, got["shipper"].blank, got["shipper"].block) == ("", True, [])
    assert (got["consignee"].raw, got["consignee"].block, got["consignee"].evidence) == ("WRAPPED LTD", ["WRAPPED LTD", "TOWN"], "Consignee / WRAPPED LTD")
    assert got["notify_party"].blank and got["notify_party"].block == ["N/A"]
    assert got["gross_weight_kg"].raw == "5 KG" and "port_of_discharge" not in got


def test_scans(spark):
    got = fields(spark, "Shlpper. ALFA\nPortof Leading; Busan\nContainer No. ABC", ocr=True)
    assert got["shipper"].raw == "ALFA" and got["port_of_loading"].raw == "Busan" and "container_count" not in got
    assert "shipper" not in fields(spark, "Shlpper. ALFA")


def test_consensus_and_tables(spark):
    doc = "struct<fields:map<string,{0}>,pass_fields:array<map<string,{0}>>,ocr:boolean,lines:array<string>,kind:string>".format(E.FIELD_TYPE)
    field = lambda x: (x, [x], False, "", False)
    base = {"shipper": field("ALFA"), "container_count": field("2")}
    si = (base, None, False, ["ABCD1234567 x", "ABCD1234568"], "SI")
    bl = ({**base, "shipper": field("ALFB")}, [{"shipper": field("ALFA")}, {"shipper": field("ALFB")}], True, ["ABCD1234567"], "BL")
    got = M.compare_documents(spark.createDataFrame([(si, bl)], f"si {doc}, bl {doc}")).first().fields
    assert (got[0].verdict, got[0].reason) == ("uncertain", "OCR passes disagree on the BL value")
    assert got[3].reason == "SI has no 'port_of_loading' field"
    same = (base, None, False, ["ABCD1234567"], "BL")
    got = M.compare_documents(spark.createDataFrame([(si, same)], f"si {doc}, bl {doc}")).first().fields
    assert (got[5].verdict, got[5].reason) == ("uncertain", "BL: document lists 1 container rows but states 2")


def test_snapping(spark):
    names = spark.createDataFrame([("ALFA PAPER LTD",), ("ALFA PAPERS LTD",), ("BRAVO CHEMICALS PTE LTD",)], "entry string")
    values = spark.createDataFrame([("BRAVO CHEMlCALS PTE LTD",), ("ALFA PAPER5 LTD",), ("OTHER",)], "value string")
    assert {tuple(r) for r in M.snap_names(values, names).collect()} == {("BRAVO CHEMlCALS PTE LTD", "BRAVO CHEMICALS PTE LTD")}
    places = spark.createDataFrame([("NHAVA SHEVA",), ("BUSAN",)], "entry string")
    values = spark.createDataFrame([("NHAVA SHEVA INDIA",), ("BUSAM",), ("BUSANN",)], "value string")
    assert {tuple(r) for r in M.snap_places(values, places).collect()} == {("NHAVA SHEVA INDIA", "NHAVA SHEVA"), ("BUSANN", "BUSAN")}


def test_scans_are_snapped(spark):
    """Misread names and places of a scan give way to those of sound documents, in all passes; other parties stay other."""
    scan = BL.replace("Alfa Paper Company", "Alfa Papcr Company").replace("Port Kelang", "Port KlangMalaysia")
    apart = scan.replace("Alfa Papcr", "A1fa Paper"), scan.replace("East Bright", "Easl Bright")
    other = BL.replace("Alfa Paper Company", "Omega Timber Company")
    texts = {"sound": (SI, BL, False, []), "scan": (SI, scan, True, []), "passes": (SI, scan, True, [scan, *apart]), "other": (SI, other, True, [other, other]), "entered": (SI, scan.replace("East Bright", "?"), True, [])}
    docs = []
    for key, (si, bl, ocr, passes) in texts.items():
        docs += [(key, 0, "a.txt", "txt", "SI", False, None, si.split("\n"), []), (key, 1, "b.txt", "txt", "BL", ocr, None, bl.split("\n"), [p.split("\n") for p in passes])]
    docs = spark.createDataFrame(docs, "email_id string, pos int, path string, fmt string, kind string, ocr boolean, error string, lines array<string>, passes array<array<string>>")
    uploads = docs.select("email_id").distinct()
    side = "map<string,string>"
    told = [("entered", None, None, None, None, (None, {"consignee": "EASF BRIGHT FZ-LLC"}))]
    told = spark.createDataFrame(told, f"email_id string, decision string, reviewer string, note string, defect_fields array<string>, corrections struct<si:{side},bl:{side}>")
    verdicts = lambda **k: {r.email_id: [f.verdict for f in r.fields] for r in P.reconcile_uploads(uploads, docs, resolutions=told, **k).collect()}
    plain, snapped = verdicts(), verdicts(entries=P.entries_of(docs))
    assert plain["sound"] == snapped["sound"] == ["match"] * 7
    assert (plain["scan"][0], plain["scan"][4]) == ("uncertain", "mismatch") and snapped["scan"] == ["match"] * 7
    assert plain["passes"][:2] == ["uncertain"] * 2 and snapped["passes"] == ["match"] * 7
    assert snapped["other"][0] == plain["other"][0] == "mismatch"
    assert plain["entered"][1] == "uncertain" and snapped["entered"] == ["match"] * 7


def test_packed_formats():
    assert readers.read_packed("a.docx", docx(["SHIPPING INSTRUCTION", " "], [["Shipper", "ALFA\nROAD"], ["one"]]))["lines"] == ["SHIPPING INSTRUCTION", "Shipper: ALFA", "   ROAD"]
    assert readers.read_packed("a.xlsx", xlsx([["TITLE"], ["Shipper", "ALFA | ROAD; TOWN"], []]))["lines"] == ["TITLE", "Shipper: ALFA", "   ROAD", "   TOWN"]
    assert readers.read_packed("a.docx", b"no")["error"].startswith("Word file could not be opened")
    assert readers.read_packed("a.zip", b"")["error"] == "unsupported attachment type .zip"


def test_messages(spark):
    mail = b'From: a@b.example\nTo: c@d.example\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/html\n\n<p>Hello &amp; bye</p>\n--x\nContent-Type: text/plain\nContent-Disposition: attachment; filename="SI.txt"\n\nSHIPPING\n--x--\n'
    got = readers.read_messages(spark.createDataFrame([("m.eml", mail), ("m.msg", b"x")], "name string, content binary")).collect()
    assert (got[0].subject, got[0]["from"], got[0].body, [a.name for a in got[0].attachments]) == ("Hi", "a@b.example", "Hello & bye", ["SI.txt"])
    assert "extract-msg" in got[1].error


def test_photos_and_rows(spark):
    row = spark.createDataFrame([(800, 0.5, 50.0, 40.0, 0.1, True, 0.2)], "px int, s double, b double, c double, g double, f boolean, fill double")
    issues = row.select(quality.judge(*[F.col(c) for c in row.columns]).alias("i")).first().i
    assert [x.level for x in issues] == ["retake", "retake", "retake", "retake", "warn", "retake"]
    words = [("b", 5.0, 0.1, 6.0, 1.1), ("a", 0.0, 0.0, 1.0, 1.0), (" ", 0.0, 0.0, 1.0, 1.0), ("c", 0.0, 3.0, 1.0, 4.0)]
    df = spark.createDataFrame([(words,)], "w array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    assert [[w.text for w in r] for r in df.select(layout.cluster_rows(F.col("w")).alias("r")).first().r] == [["a", "b"], ["c"]]


def test_stream(spark, folder, tmp_path):
    stream.write_classified(stream.stream_emails(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == len(CASES) and got.where("category = 'INVOICE_QUERY'").count() == 1


def test_report_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"email_id": "a", "status": "OK"}]')
    (tmp_path / "map.json").write_text('{"b": {"status": "MISMATCH"}}')
    read = lambda name: [tuple(r) for r in I.read_report(spark, str(tmp_path / name), "email_id:string,status:string").collect()]
    assert read("list.json") == [("a", "OK")] and read("map.json") == [("b", "MISMATCH")]


def test_command_line(spark, folder, tmp_path, monkeypatch):
    """A run, a retry with decisions of a file and saved ones; a scan is snapped to names of the whole inbox, retried alone too."""
    import shutil

    from ledgerlark.__main__ import main
    from ledgerlark.sources.shared import shared_folder

    shutil.copytree(folder, tmp_path / "in")
    scan = BL.replace("Alfa Paper Company", "Alfa Papcr Company")
    for name, text in (("a.txt", SI), ("scan.tif", scan)):
        (tmp_path / "in/attachments" / name).write_text(text)
    (tmp_path / "in/inbox/email_09.json").write_text(json.dumps({"email_id": "email_09", "from": "", "subject": "", "body": "", "attachments": ["attachments/a.txt", "attachments/scan.tif"]}))
    read = readers.read_documents
    # In the place of an OCR engine: the file's own text, as a scan.
    text = F.split(I.utf8_text(F.col("content")), "\n")
    scanned = lambda files: read(files.where("path not like '%.tif'")).unionByName(
        files.where("path like '%.tif'").select("email_id", "pos", "path", F.lit("photo").alias("fmt"), F.lit("BL").alias("kind"), F.lit(True).alias("ocr"), F.lit(None).cast("string").alias("error"), text.alias("lines"), F.array().cast("array<array<string>>").alias("passes")))
    monkeypatch.setattr(P, "read_documents", scanned)
    out = str(tmp_path / "out")
    status = lambda: {r["email_id"]: r["status"] for r in json.loads((tmp_path / "out/report.json").read_text())}
    main([str(tmp_path / "in"), "--out", out])
    before = status()
    assert before["email_09"] == "OK" and {k: before[k] for k in CASES} == {k: v[1] for k, v in CASES.items()}
    (tmp_path / "r.json").write_text('{"email_03": {"decision": "OK"}, "email_04": {"decision": "OK"}}')
    saved = ["--resolutions", str(tmp_path / "r.json"), "--saved", str(tmp_path / "saved"), "--resolve", "email_05=OK", "--note", "seen"]
    main([str(tmp_path / "in"), "--out", out, *saved, "--retry", "email_03", "email_05", "email_09"])
    assert status() == {**before, "email_03": "OK", "email_05": "OK"}  # email_04 is decided too, but not run again
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}")
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)  # intermediate tables are gone
    with pytest.raises(SystemExit):
        main([str(tmp_path / "in"), "--out", out, "--resolve", "email_05=OK"])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_a_score_do_not_score_again(spark):
    texts = spark.createDataFrame([("a", "OCEAN STAR LINES"), ("a", None)], "k string, line string")
    pairs = M.likely_pairs(texts.select(F.col("line").alias("value")), texts.select(F.col("line").alias("entry")), 84.0)
    assert plan_of(pairs).count("_ratios(") == 1
    evidence = texts.select("k", F.lit("shipper").alias("field"), F.col("line").alias("evidence"))
    best = layout.best_lines(evidence, texts.select("k", F.lit(1).alias("line_no"), F.concat("line", F.lit("!")).alias("line")), ["k"])
    assert plan_of(best).count("_ratios(") == 1
    assert [(r["field"], r["line_no"]) for r in best.collect()] == [("shipper", 1)]


def test_filters_on_results_do_not_compare_again(spark):
    costly = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda x: F.sha2(x.cast("string"), 256))
    rows = dealing.once(spark.range(1, 4).withColumn("b`c", F.lit(0)), "found", F.when(F.col("id") > 1, costly))
    used = rows.withColumn("n", F.size("found")).where((F.col("n") > 1) & F.array_contains("found", "x").isNotNull()).where("n < 3")
    assert plan_of(used).count("sha2(") == 1
    assert [(r["id"], r["b`c"], r["n"]) for r in used.collect()] == [(2, 0, 2)]
    assert rows.where("found is null").count() == 1  # a null stays a row


def test_rows_of_a_page_are_made_once_and_not_moved(spark):
    word = F.struct(F.sha2(F.col("doc"), 256).alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(8.0).alias("y1"))
    docs = dealing.dealt(spark.createDataFrame([("a",), ("b",)], "doc string"), "doc")
    wanted = docs.select("doc", F.lit("shipper").alias("field"), F.col("doc").alias("value"), F.when(F.col("doc") == "a", F.upper(F.sha1("doc"))).otherwise("x").alias("evidence"))
    found = layout.locate(wanted, docs.select("doc", F.lit(1).alias("page"), F.array(word).alias("words")), ["doc"])
    assert plan_of(found).count("sha2(") == 1
    shuffles = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    assert shuffles <= 2  # those that the documents were dealt by
    assert found.collect() == []


def test_dealt_parts_grow_with_rows_and_stay(spark):
    rows = dealing.dealt(spark.range(9).groupBy("id").count(), "id", rows=11 * dealing.ROWS)
    assert rows.rdd.getNumPartitions() == 11
    assert dealing.dealt(spark.range(9).groupBy("id").count(), "id").rdd.getNumPartitions() >= 4


def test_lines_meet_evidence_within_one_value(spark):
    texts = spark.createDataFrame([("a", 1, "x"), ("a", 2, "OCEAN STAR LINE"), ("a", 3, "ocean star-lines"), ("a", 4, "OCEAN STAR LINES"), ("b", 1, "OCEAN STAR LINE"), ("b", 2, "")], "k string, line_no int, line string")
    evidence = spark.createDataFrame([("a", "shipper", "Ocean Star Lines"), ("b", "shipper", "Ocean Star Lines"), ("b", "consignee", ""), ("c", "shipper", "x")], "k string, field string, evidence string")
    best = layout.best_lines(evidence, texts, ["k"])
    assert plan_of(best).count("Window [") == 1  # the last choice; pairs pass no other
    assert sorted((r["k"], r["field"], r["line_no"], round(r["score"], 2)) for r in best.collect()) == [("a", "shipper", 3, 100.0), ("b", "shipper", 1, 96.77)]


def test_windows_sort_no_lines_and_join_nothing(spark):
    rows = [(1, 1, "Shipper: ACME"), (1, 2, "  12 ROAD"), (1, 3, " \tWEST"), (1, 4, "Shipper: OTHER"), (1, 5, "net weight: 1 KG"), (1, 6, "\tPOD: X"), (1, 7, "POD: BUSAN　"), (1, 8, "Consignee:"), (1, 9, " below"), (2, 1, " Shipper: A"), (2, 2, None), (2, 3, "to the order of B"), (2, 4, "  C")]
    found = E.extract_flush_left(spark.createDataFrame(rows, "doc int, line_no int, line string"), ["doc"])
    plan = plan_of(found)
    assert "Join" not in plan and plan.count("(?i)^\\s*net\\s*(weight|wt)") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "consignee", "", True, 0), (1, "port_of_discharge", "BUSAN", False, 1), (1, "shipper", "ACME", False, 3), (2, "consignee", "B", False, 2)]


def test_labels_are_tried_by_their_first_letter(spark):
    lines = ["shipper A", "\tPOL: B", " gross wt: 5", "Total  containers 4", "TOTAL GROSS WEIGHT 7", "no of containers: 3", "Discharge Port X", "(毛重)Load Port Y", "Load Port Z", "Containers 9", "to the order of Z", "Vessel: Q", "", "  "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("c", E.clean_line(F.col("line")))
    plain = F.filter(F.array(*[F.when(F.col("c").rlike(E.label_pattern(f)), F.lit(f)) for f in E.FIELDS]), lambda f: f.isNotNull())
    tried = F.transform(E._hits(F.col("c"), E._first(F.col("c"))), lambda h: h["field"])
    got = df.select("i", plain.alias("a"), tried.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(len(r.a) for r in got) >= 10


def test_names_lose_whom_they_act_for_before_they_are_shuffled(spark):
    field = F.struct(F.concat(F.lit("Acme Co., Limited on behalf of "), F.col("id").cast("string")).alias("raw"), F.array().cast("array<string>").alias("block"), F.lit(False).alias("blank"))
    docs = spark.range(50).select(F.create_map(F.lit("shipper"), field).alias("fields"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("ocr"), F.lit("SI").alias("kind"))
    names = M.vocabulary(docs)
    assert [tuple(r) for r in names.collect()] == [("name", "ACME CO LTD")]
    below, above = plan_of(names).split("Aggregate [")[-1], plan_of(names).split("Aggregate [")[1]
    assert plan_of(names).count("Aggregate [") == 2 and "behalf" in below and "behalf" not in above
