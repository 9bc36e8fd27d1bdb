"""Table-driven tests of the column library."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions import normalise as N
from ledgerlark.functions import similarity as S
from ledgerlark.functions import text as X


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("r")).collect()]


def test_weights(spark):
    cases = {"131,058 KG": 131058.0, "131058": 131058.0, "131.058 MT": 131058.0, "131058.00 KGS": 131058.0, "131,058.0 kg": 131058.0, "128.544 KG": 128544.0, "N/A": None, "": None, None: None, "1.234,5 kg": 1234.5, "12,5 T": 12500.0, "100 lbs": 45.359, "2 x 21,577 KG": 2.0}
    assert each(spark, list(cases), N.weight_kg) == list(cases.values())


def test_counts(spark):
    cases = {"6 x 40'HC": 6, "15 x 20'GP": 15, "THREE": 3, "2 x 40'HC + 1 x 20'GP": 3, "7": 7, "40'HC x 6": 40, "65PCS": None, "seventeen": None, "twelve boxes": 12, "": None, None: None}
    assert each(spark, list(cases), N.container_count) == list(cases.values())


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("EAST BRIGHT FZ-LLC", "East Bright FZ LLC", True), ("ACME CO., LTD", "Acme Company Limited", True), ("A & B Corp.", "A and B Corporation", True),
        ("ALFA TRADING", "ALFA TRADING (MIDDLE EAST) FZE", False), ("X SDN. BHD.", "X Sdn Bhd", True), ("One Inc", "Two Inc", False),
    ],
)
def test_names(spark, a, b, same):
    x, y = each(spark, [a, b], lambda c: X.squash(N.canon_name(c)))
    assert (x == y) == same


def test_ports(spark):
    cases = {
        "PORT KLANG (WESTPORT), MALAYSIA": ("PORT KLANG", "MALAYSIA"), "Port Kelang": ("PORT KLANG", None), "Ho Chi Minh, Vietnam": ("HOCHIMINH CITY", "VIETNAM"), "hochiminh": ("HOCHIMINH CITY", None),
        "Busan (KRPUS), Korea": ("BUSAN", "SOUTH KOREA"), "A, B, U S A": ("A, B", "USA"), " , X , ": ("X", None), None: (None, None),
    }
    assert [tuple(r) for r in each(spark, list(cases), N.canon_port)] == list(cases.values())


def test_placeholders(spark):
    cases = {"N/A": True, "tba": True, "____MT": True, "??? MTS": True, "--": True, "xx": True, "unknown": True, "x ray": False, "Busan": False, "a___b": True, "": False}
    assert each(spark, list(cases), X.is_placeholder) == list(cases.values())


def test_lines(spark):
    texts = ["a\nb\n", "a\r\nb\rc", "", "\n", "a b\x85c", "a\n\nb"]
    assert each(spark, texts, X.split_lines) == [t.splitlines() for t in texts]


def test_small_texts(spark):
    assert each(spark, ["RE: FW_ re: Hi", "Hi", "", None], X.reply_subject) == ["RE: Hi", "RE: Hi", "RE: Shipping document check", "RE: Shipping document check"]
    assert each(spark, ["<b>\"'&", "", None], X.escape_html) == ["&lt;b&gt;&quot;&#x27;&amp;", "—", "—"]
    assert each(spark, ["<p>a&amp;b</p><style>x</style>c"], X.html_to_text) == ["a&b\n c"]
    assert each(spark, ["a b/c~*+é"], X.percent_encoded) == ["a%20b/c~%2A%2B%C3%A9"]
    assert each(spark, ["毛重(毛重 KGS) kg", "a □ b"], X.strip_cjk) == [" kg", "a  b"]
    assert each(spark, [6.0, 131058.5, 22.5, 0.0, 1234567.0], X.general, "double") == [f"{x:g}" for x in (6.0, 131058.5, 22.5, 0.0, 1234567.0)]


def test_closed_entities_alone(spark):
    texts = ["a&amp b&amp;&amp", "&copy;&#39;&nosuch;&amp;lt;", None]
    assert each(spark, texts, lambda c: X.html_to_text(c, closed=True)) == ["a&amp b&&amp", "©'&nosuch;&lt;", None]
    assert each(spark, texts[:1], X.html_to_text) == ["a& b&&"]


def test_shortcuts_are_the_patterns(spark):
    from ledgerlark import constants as K

    odd = ["", " ", "a", " a  b ", "a\tb", "\u00a0a\u2003 b\u3000", "a     b", "\na\r\n", "é  è", "n/a", " TBA ", "\tnil", "x ray", "ab___", "??? MT", "-- ", "___", "unknown\n", None]
    whole = lambda c: X.strip(F.regexp_replace(c, r"(?U)\s+", " "))
    assert each(spark, odd, X.tidy) == each(spark, odd, whole)
    assert each(spark, odd, X.stripped) == each(spark, odd, X.strip)
    assert each(spark, odd, lambda c: X.is_placeholder(c).cast("string")) == each(spark, odd, lambda c: c.rlike(K.PLACEHOLDER).cast("string"))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_bit_parallel_lcs(a, b):
    assert S.lcs(a, b) == plain_lcs(a, b)


def test_column_ratio_is_the_arrow_ratio(spark):
    words = ["KITTEN", "SITTING", "", "A", "ACMELTD", "ACNELTD", "KITTEN"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", S.ratio(F.col("a"), F.col("b")).alias("x"), S.ratio_udf(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == pytest.approx(r.y) == pytest.approx(S.ratio_of(r.a, r.b))
    assert S.partial_ratio_of("ABC", "XXABCXX") == 100.0


def test_bit_parallel_column_ratio(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("AB1ZQ9") for _ in range(n))
    rows = [(word(rng.randint(0, 70)), word(rng.randint(0, 70))) for _ in range(150)] + [("", ""), ("A", ""), ("", "A"), ("A" * 62, "A" * 61), ("A" * 63, "AB"), ("9" * 62, "9Z" * 40), ("ABC", "ABC")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.squashed_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - S.ratio_of(r.a, r.b)) < 1e-9 for r in got)
