"""Locally consistent parsing against a parser that goes symbol by symbol; fingerprints and likeness; documents and their successors."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import fingerprints as P
from tests.llm.samples import SCHEMA, clashing, documents, prose


def plain_labels(names: list[int]) -> list[int]:
    labels = names
    for _ in range(4):
        out = []
        for i, x in enumerate(labels):
            before = labels[i - 1] if i else x ^ 1
            differ = (x ^ before) or 1
            low = (differ & -differ).bit_length() - 1
            out.append(2 * low + (x >> low & 1))
        labels = out
    return labels


def plain_cut(names: list[int]) -> list[int]:
    """Where phrases begin, counted in symbols whose runs are one."""
    lab = plain_labels(names)
    return [i for i in range(len(names)) if i == 0 or (0 < i < len(names) - 1 and lab[i - 1] > lab[i] < lab[i + 1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=4))
def test_phrases_begin_where_plain_ones_do(texts):
    joined = P._BYTES[np.array(sum(texts, []))]
    first = np.cumsum([0, *map(len, texts[:-1])])
    names, begins = P.phrases(joined, first)
    at = 0
    for k, text in enumerate(texts):
        runs = [(x, n) for x, n in _runs(text)]
        symbols = [int(P._BYTES[x]) if n == 1 else int(P._mixed(P._BYTES[[x]] + np.array([n], np.uint64) * P._GOLD)[0]) for x, n in runs]
        assert (begins[k + 1] if k + 1 < len(begins) else len(names)) - at == len(plain_cut(symbols))
        alone, _ = P.phrases(P._BYTES[np.array(text)], np.array([0]))
        assert names[at : at + len(alone)].tolist() == alone.tolist()  # other texts have no bearing
        at += len(alone)


def _runs(text):
    out = []
    for x in text:
        if out and out[-1][0] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=80, unique=True))
def test_labels_are_few_and_phrases_short(names):
    labels = P._tossed(np.array(names, np.uint64), np.array([0]))
    assert labels.max() < 6 and (labels[1:] != labels[:-1]).all()
    assert labels.tolist() == plain_labels(names)


def names_at(text: str, level: int) -> list[int]:
    names, first = P._BYTES[np.frombuffer(text.encode(), np.uint8)], np.array([0])
    for _ in range(level):
        names, first = P.phrases(names, first)
    return names.tolist()


@pytest.mark.parametrize("before", ["", "x", "a few words ", prose(8, 50), "aaaa"])
def test_equal_substrings_share_interior_names(before):
    inner = prose(3, 400)
    for level in (1, 2, 3):
        own, other = names_at(inner, level), names_at(before + inner + prose(9, 7), level)
        middle = own[12:-12]
        assert any(other[i : i + len(middle)] == middle for i in range(len(other)))


def test_likeness():
    a, b = prose(1, 300), prose(2, 300)
    names = lambda t: P.names_of(P.fingerprints([t])[0])
    assert P.likeness(names(a), names(a)) == 1.0 == P.likeness(names(""), names(""))
    assert P.likeness(names(a), names("")) == 0.0 == P.likeness(names(""), names(a))
    assert P.likeness(names(a), names(b)) < 0.35 < 0.8 < P.likeness(names(a), names(a + " end"))
    assert P.fingerprints([]) == [] and P.fingerprints(["", ""]) == ["", ""]
    assert len(P.fingerprints([prose(1, 20000)])[0]) == len(P.LEVELS) * 8 * P.NAMES + len(P.LEVELS) - 1
    whole = {t: P.fingerprints([t])[0] for t in (a, b, "", "x", "aaaa", "é")}
    assert P.fingerprints([*whole, a]) == [*whole.values(), whole[a]]


def test_blocks_dont_change_fingerprints(monkeypatch):
    texts = [prose(i, 40) for i in range(9)] + ["", "x", prose(99, 5000)]
    once = P.fingerprints(texts)
    monkeypatch.setattr(P, "AT_ONCE", 300)
    assert P.fingerprints(texts) == once


def plain_rows(rows: list[tuple]) -> list[tuple]:
    """Rows in order, with the digest of the edited text and both likenesses."""
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        own, edited, after = (P.names_of(P.fingerprints([x])[0]) for x in (t, cut, n))
        out.append((i, len(t), hashlib.sha256(cut.encode()).hexdigest(), *P.fingerprints([t, cut]), P.likeness(own, edited), P.likeness(own, after)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("at_once", [1 << 20, 200])
def test_documents_and_their_successors(spark, monkeypatch, parts, at_once):
    monkeypatch.setattr(P, "AT_ONCE", at_once)
    df = clashing(spark.createDataFrame(documents(), SCHEMA)).repartition(3)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [tuple(r) for r in P.edited_likeness(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    tie = {(r.id, r.text): r.tie for r in df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    rows = sorted(((i, t or "") for i, t, *_ in documents()), key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))
    assert sorted(got, key=str) == sorted(plain_rows(rows), key=str)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(7, "one text of some words")], "doc_id long, text string")
    (r,) = P.edited_likeness(df).collect()
    assert r.n_chars == 22 and r.near_next == 1.0
    assert P.edited_likeness(df.limit(0)).count() == 0
    (null,) = P.edited_likeness(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert null.n_chars == 0 and null.fingerprint == "" and null.near_edited == 1.0


def test_the_operator_alone(spark):
    df = clashing(spark.createDataFrame([(1, "some text"), (2, None), (2, None), (3, "")], "doc_id long, text string")).withColumn("fingerprint", F.lit("mine"))
    got = P.fingerprinted(df)
    assert got.columns[-1] == "_fingerprint" and [r["_fingerprint"] for r in got.collect()] == P.fingerprints(["some text", "", "", ""])
    near = P.fingerprinted(df).select(P.likeness_of(F.col("_fingerprint"), F.lit("")).alias("x"))
    assert [r["x"] for r in near.collect()] == [0.0, 1.0, 1.0, 1.0]
    assert P.fingerprinted(df.limit(0)).count() == 0
