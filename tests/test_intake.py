"""What comes in and goes out: uploads, names, PDF text, evidence, order, JSON documents, saved decisions."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions.lenient import json_object, object_in
from ledgerlark.functions.similarity import ratio_of
from ledgerlark.operators import alike, layout, quality
from ledgerlark.sources import documents, inbox, readers, resolutions, uploads
from ledgerlark.sources.pdf import Broken, pdf_words
from tests.samples import pdf, pdf_of

SI = """SHIPPING INSTRUCTION
Shipper: ALFA PAPER CO., LTD
  12 HARBOUR ROAD
Consignee: EAST BRIGHT FZ-LLC
Notify Party: EAST BRIGHT FZ-LLC
Port of Loading (POL): BUSAN, KOREA
Gross Weight(KGS): 131,058 KG"""
MAIL = b'From: a@b.example\nSubject: Two files\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="x"\n\n--x\nContent-Type: text/html\n\n<p>See &amp; compare</p>\n--x\nContent-Type: text/plain\nContent-Disposition: attachment; filename="SI.txt"\n\nSHIPPING\n--x\nContent-Type: text/plain\nContent-Disposition: attachment; filename="scan.jpg"\n\nBILL\n--x--\n'


def test_uploads_become_messages_and_documents(spark):
    rows = [("a", 0, "scan.jpg", b"loose"), ("a", 1, "one.eml", MAIL), ("a", 2, "two.eml", MAIL), ("a", 3, "SI.txt", b"again"), ("b", 0, "x.txt", b"x"), ("c", 0, "m.msg", b"?")]
    files = spark.createDataFrame(rows, "upload_id string, pos int, name string, content binary").repartition(3)
    messages, docs = uploads.read_uploads(files)
    assert {(m.email_id, m.subject, m["from"], m.body) for m in messages.where("error is null").collect()} == {("a", "Two files", "a@b.example", "See & compare")}
    assert "extract-msg" in messages.where("email_id = 'c'").first().error
    got = {(d.email_id, d.pos): (d.path, bytes(d.content).strip()) for d in docs.collect()}
    assert got == {("a", 0): ("SI.txt", b"SHIPPING"), ("a", 1): ("scan.jpg", b"BILL"), ("a", 2): ("scan_2.jpg", b"loose"), ("a", 3): ("SI_2.txt", b"again"), ("b", 0): ("x.txt", b"x")}
    assert uploads.read_uploads(files.limit(0))[1].count() == 0


def test_no_two_names_are_equal(spark):
    rng = random.Random(1)
    names = ["scan.jpg", "scan_2.jpg", "_scan_2.jpg", "scan_3.jpg", "scan_2_2.jpg", "note", "note_2", ".x", "a."]
    rows = [(f"u{k}", i, rng.choice(names)) for k in range(30) for i in range(rng.randint(1, 25))]
    rows += [("v", i, n) for i, n in enumerate(["scan.jpg", "scan.jpg", "scan_2.jpg", "_scan_2.jpg"])]
    got = inbox.unique_names(spark.createDataFrame(rows, "upload_id string, pos int, name string").repartition(5)).collect()
    assert len({(r.upload_id, r.unique_name) for r in got}) == len(got) == len(rows)
    first = {}
    for r in sorted(got, key=lambda r: r.pos):
        first.setdefault((r.upload_id, r.name), r)
    assert [r.unique_name for r in sorted(got, key=lambda r: r.pos) if r.upload_id == "v"] == ["scan.jpg", "scan_2.jpg", "scan_2_2.jpg", "_scan_2.jpg"]


@pytest.mark.parametrize("how", [{}, {"packed": False}, {"table": False}, {"cid": True}])
def test_pdf_text_is_its_twins(spark, how):
    files = [("e", 0, "a.pdf", pdf_of(SI, **how)), ("e", 1, "a.txt", SI.encode()), ("e", 2, "bad.pdf", b"hello"), ("e", 3, "cut.pdf", b"%PDF-1.4 nothing"), ("e", 4, "scan.pdf", pdf([[(50, 50, "few letters")]])), ("e", 5, "blank.pdf", pdf([[]]))]
    docs = {d.path: d for d in readers.read_documents(spark.createDataFrame([(e, p, n, bytearray(c)) for e, p, n, c in files], "email_id string, pos int, path string, content binary")).collect()}
    plain = lambda d: [" ".join(x.split()) for x in d.lines]
    assert plain(docs["a.pdf"]) == plain(docs["a.txt"]) and docs["a.pdf"].kind == "SI" and docs["a.pdf"].fmt == "pdf"
    assert docs["a.pdf"].lines[2].startswith("  12 HARBOUR") and not docs["a.pdf"].lines[3].startswith(" ")
    assert docs["bad.pdf"].error == "not a PDF (bad header)" and "corrupt" in docs["cut.pdf"].error
    assert (docs["scan.pdf"].fmt, docs["scan.pdf"].ocr, docs["blank.pdf"].ocr) == ("pdf_scan", True, True) and "OCR" in docs["scan.pdf"].error


def test_pdf_pages_and_words():
    one = pdf([[(50, 40, "Left"), (300, 40, "Right (a)")], [(60, 90, "Two")]])
    pages = pdf_words(one)
    assert [[w[0] for w in p] for p in pages] == [["Left", "Right", "(a)"], ["Two"]]
    assert pages[0][1][1:] == pytest.approx((300.0, 32.0, 330.0, 42.0))
    for broken in (one[: len(one) // 3], b"%PDF-", one.replace(b"/Kids", b"/Kinds").replace(b"/Pages 2 0 R", b"/Pages 9 0 R")):
        try:
            pdf_words(broken)
        except Broken:
            pass


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1500), st.binary(max_size=12))
def test_a_damaged_pdf_never_crashes(at, junk):
    whole = pdf_of(SI)
    try:
        pdf_words(whole[:at] + junk + whole[at + len(junk) :])
    except Broken:
        pass


def test_evidence_lands_on_its_own_row(spark):
    pages = [[dict(zip(("text", "x0", "y0", "x1", "y1"), w, strict=True)) for w in p] for p in pdf_words(pdf_of(SI))]
    words = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
    wanted = [("d", "shipper", "Shipper: ALFA PAPER CO., LTD", "ALFA PAPER CO., LTD"), ("d", "consignee", "Consignee: EAST BRIGHT FZ-LLC", "EAST BRIGHT FZ-LLC"), ("d", "notify_party", "Notify Party: EAST BRIGHT FZ-LLC", "EAST BRIGHT FZ-LLC"),
              ("d", "gross_weight_kg", "Gross Weight(KGS): 131,058 K6", "131,058 KG"), ("d", "street", "", "12 HARBOUR ROAD"), ("d", "nothing", "Vessel: NONE OF THESE", "QQQQ"), ("d", "line", "SHIPPING INSTRUCTION", "")]
    got = {r.field: r for r in layout.locate(spark.createDataFrame(wanted, "doc string, field string, evidence string, value string"), spark.createDataFrame([("d", i, p) for i, p in enumerate(pages)], f"doc string, page int, words {words}"), ["doc"]).collect()}
    assert {k: r.text for k, r in got.items()} == {
        "shipper": "ALFA PAPER CO., LTD", "consignee": "EAST BRIGHT FZ-LLC", "notify_party": "EAST BRIGHT FZ-LLC", "gross_weight_kg": "131,058 KG", "street": "12 HARBOUR ROAD", "line": "SHIPPING INSTRUCTION",
    }
    assert got["consignee"].box.y0 < got["notify_party"].box.y0 and got["shipper"].box.x0 > 50
    assert got["consignee"].row == 3 and got["notify_party"].row == 4


def test_photographed_pages_are_joined_in_order(spark):
    rows = [("e", 0, 2, ["third line"], ["3rd line"]), ("e", 0, 1, ["first", "second"], ["1st"]), ("e", 0, 3, None, ["last line"]), ("f", 0, 1, ["a"], ["bc"]), ("g", 1, 1, None, None)]
    got = {r.email_id: r for r in quality.joined_pages(spark.createDataFrame(rows, "email_id string, pos int, page int, a array<string>, b array<string>")).collect()}
    assert got["e"].passes == [["first", "second", "third line"], ["1st", "3rd line", "last line"]] and got["e"].lines == got["e"].passes[0] and got["e"].error is None
    assert got["f"].error == got["g"].error == "no readable text found in the photo" and got["f"].lines == []


@pytest.mark.parametrize("parts", [1, 7])
def test_ordinals_have_no_gap(spark, parts):
    names = [f"email_{i:03d}" for i in range(50)] + ["email_007", None]
    df = spark.createDataFrame([(n,) for n in names], "file string").repartition(parts)
    got = sorted((r["ord"], r["file"]) for r in documents.with_ordinals(df, ["file"]).collect())
    assert [o for o, _ in got] == list(range(52)) and [f for _, f in got] == sorted(names, key=lambda x: x or "")
    assert documents.with_ordinals(df.limit(0), ["file"]).count() == 0


def test_json_documents(spark, tmp_path):
    rows = [(i, f'k"{i}', None if i % 3 else [f"ü\n{i}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "n int, id string, items array<string>").repartition(6)
    documents.write_json_document(df, f"{tmp_path}/list.json", ["n"])
    documents.write_json_document(df, f"{tmp_path}/list.json", ["n"])  # again: what was there is replaced
    assert json.loads((tmp_path / "list.json").read_text()) == [{"n": n, "id": i, "items": x} for n, i, x in rows]
    documents.write_json_document(df, f"{tmp_path}/map.json", ["n"], key="id")
    found = json.loads((tmp_path / "map.json").read_text())
    assert found == {i: {"n": n, "items": x} for n, i, x in rows} and list(found) == [i for _, i, _ in rows]
    for key, want in ((None, []), ("id", {})):
        documents.write_json_document(df.limit(0), f"{tmp_path}/none.json", ["n"], key)
        assert json.loads((tmp_path / "none.json").read_text()) == want


def test_two_reviewers_lose_no_decision(spark, tmp_path):
    folder = str(tmp_path / "saved")
    assert resolutions.read_saved(spark, folder).count() == 0
    told = lambda who, ids, decision: spark.createDataFrame([(i, decision, who) for i in ids], "email_id string, decision string, reviewer string")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: resolutions.save(told(f"r{k}", [f"e{k}", f"f{k}"], "OK"), folder), range(4)))
    assert sorted(versions) == [1, 2, 3, 4]
    assert resolutions.save(told("late", ["e0"], "MISMATCH"), folder) == 5
    got = {r.email_id: (r.decision, r.reviewer) for r in resolutions.read_saved(spark, folder).collect()}
    assert got == {f"{x}{k}": ("OK", f"r{k}") for k in range(4) for x in "ef"} | {"e0": ("MISMATCH", "late")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('Sure: {"a": "x } y"} and {no', {"a": "x } y"}), ('```json\n{"a": {"b": [1, {"c": "\\"}"}]}}\n```', {"a": {"b": [1, {"c": '"}'}]}}), ('{bad} then {"a": 1} or {"b": 2}', {"a": 1}),
        ("no object", None), ("", None), (None, None), ("{", None), ("} {", None), ('{"a": 1', None), ("{}", {}), ('{"a":\n```json\n1}', {"a": 1}),
    ],
)
def test_lenient_json(spark, text, want):
    assert object_in(text) == want


def test_lenient_json_column(spark):
    got = spark.createDataFrame([('x {"a": "ü}"} y',), (None,), ("{",)], "t string").select(json_object(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == ['{"a": "ü}"}', None, None]


def test_letter_pairs_lose_no_alike_name(spark):
    """Two thousand names against three hundred misread ones: the pairs of brute force, and few candidates for each value."""
    rng = random.Random(3)
    heads, tails = ["ALFA", "BRAVO", "DELTA", "EAST", "GOLDEN", "HARBOUR", "ORIENT", "PACIFIC", "SILVER", "UNITED"], ["PAPER", "STEEL", "TIMBER", "TRADING", "CHEMICALS", "FOODS", "MARINE", "TEXTILES"]
    names = sorted({f"{rng.choice(heads)} {rng.choice(tails)} {rng.choice(heads)[:3]}{rng.randint(1, 99)} {rng.choice(['LTD', 'INC', 'PTE LTD', 'CO'])}" for _ in range(2600)})[:2000]
    misread = []
    for n in rng.sample(names, 290):
        at = rng.randrange(len(n))
        misread.append(n[:at] + rng.choice(["", "X", n[at] * 2]) + n[at + 1 :])
    misread += ["A", "AB", "", "!!", "ZZZZZZZZZZ", names[0], names[0] * 3, "LTD", "1", "PAPER ALFA"]
    values = spark.createDataFrame([(v,) for v in dict.fromkeys(misread)], "value string")
    entries = spark.createDataFrame([(n,) for n in [*names, "A", "1", "", "AB", "ABC"]], "entry string")
    plain = lambda s: "".join(c for c in s.upper() if c.isalnum())
    for least in (84.0, 70.0):
        some = list(dict.fromkeys(misread))[-40:] if least == 70.0 else list(dict.fromkeys(misread))
        got = {(r.value, r.entry): r.score for r in alike.likely_pairs(values.where(F.col("value").isin(some)), entries, least).collect()}
        want = {(v, n): s for v in some for n in [*names, "A", "1", "", "AB", "ABC"] if plain(v) and plain(n) and (s := ratio_of(plain(v), plain(n))) >= least}
        assert got == pytest.approx(want)
    assert alike.candidate_pairs(values, entries, 84.0).count() < 0.02 * len(set(misread)) * len(names)
    with pytest.raises(ValueError, match="70"):
        alike.candidate_pairs(values, entries, 60.0)


def test_the_first_report_there_is(spark, tmp_path):
    schema = "email_id:string,status:string"
    for name in ("own", "sample"):
        (tmp_path / name).mkdir()
    (tmp_path / "sample/report.json").write_text('[{"email_id": "a", "status": "OK"}]')
    both = [str(tmp_path / "own"), str(tmp_path / "sample")]
    assert [tuple(r) for r in inbox.read_first_report(spark, both, schema).collect()] == [("a", "OK")]
    (tmp_path / "own/report.json").write_text('{"b": {"status": "MISMATCH"}}')
    assert [tuple(r) for r in inbox.read_first_report(spark, both, schema).collect()] == [("b", "MISMATCH")]
    assert inbox.read_first_report(spark, [str(tmp_path)], schema).columns == ["email_id", "status"]
    (tmp_path / "t.json").write_text('{"c": {"status": "OK", "has_defect": false}}')
    assert [tuple(r) for r in inbox.read_template(spark, str(tmp_path / "t.json"), "status:string,has_defect:boolean").collect()] == [("c", "OK", False)]
