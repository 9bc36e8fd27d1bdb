"""Exact dedup, urls, personal data, BPE and packing against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import bpe, exact_dedup, marks, packing, pii, url_filter
from ledgerlark.llm.vocabulary import read_vocabulary, tokenizer, vocabulary_file
from ledgerlark.sources.shared import written
from tests.llm.samples import SCHEMA, clashing, documents


def ascii_low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(ascii_low(r.text).encode()).hexdigest()].append(r.doc_id)
    got = exact_dedup.exact_dedup(clashing(docs)).collect()
    assert sorted((r.text_sha256, r.doc_id or -1) for r in got) == sorted((k, i or -1) for k, v in groups.items() for i in v)
    for r in got:
        own = groups[r.text_sha256]
        keep = max((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)


def test_exact_dedup_with_a_full_bitmap(spark, docs, monkeypatch):
    """Bits that keys share by chance change no result."""
    monkeypatch.setattr(marks, "BITS", 4)
    monkeypatch.setattr(marks, "PAGE", 3)
    test_exact_dedup(spark, docs)
    test_exact_dedup_names_and_empty(spark, docs)


def exchanged_texts(df):
    """Exchanges of the plan that move a column named text."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [cols for cols in re.findall(r"\) Exchange\s*\nInput[^:]*: \[(.*)\]", plan) if re.search(r"\btext#", cols)]


def test_rows_that_stay_do_not_move(spark, docs):
    docs = written(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    gone = docs.select("doc_id").where("doc_id in (3, 7)").distinct()
    left = marks.without(docs, gone, "doc_id")
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(r.doc_id or -1 for r in docs.collect() if r.doc_id not in (3, 7))
    assert sorted(r.doc_id for r in marks.within(docs, gone, "doc_id").collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id in (3, 7))
    # The one exchange with texts has only rows that share a bit by chance; here there is none.
    assert len(exchanged_texts(left)) == 1
    assert exchanged_texts(exact_dedup.exact_dedup(docs)) == []
    assert marks.without(docs, gone.limit(0), "doc_id").count() == docs.count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_exact_dedup_names_and_empty(spark, docs):
    more = clashing(docs)
    assert exact_dedup.kept_rows(more).columns == more.columns
    assert exact_dedup.kept_rows(more).count() == exact_dedup.kept_rows(docs).count()
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


URLS = [
    ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://blog.example.com/en/a", "blog.example.com", "/en/a", "example.com/en/", "block"),
    ("https://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
    ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
    ("http://x.net/de/1", "x.net", "/de/1", None, "allow"),
    ("http://com", "com", "", None, "allow"),
    ("http://ads-track.example.org/en/1", "ads-track.example.org", "/en/1", None, "block"),
    ("http://uploads.example.org/1", "uploads.example.org", "/1", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_urls(spark):
    rows = [(i, u[0]) for i, u in enumerate(URLS)] * 2
    df = clashing(spark.createDataFrame(rows, "page_id int, url string"))
    got = url_filter.judge_urls(df)
    assert got.columns[: len(df.columns)] == df.columns
    for r in got.collect():
        assert tuple(r)[-4:] == URLS[r.page_id][1:]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.PatternRule(p) for p in (r"/common/rare\.", r"/common/other(?:[?#]|$)", "ab+c", "/shop[0-9]")]
    assert set(url_filter.pattern_index(rules)) == {"rare", "other", ""}
    assert url_filter.pattern_index([]) == {}


def test_derived_tokens():
    rules = {r.pattern: url_filter.literal_tokens(r.pattern) for r in url_filter.PATTERN_RULES}
    assert all(rules.values())  # no shipped rule is tried on every url
    some = {r"/wp-login\.php(?:[?#]|$)": ("wp", "login", "php"), r"[?&;]sessionid=[0-9a-f]{16}": ("sessionid",), r"://(?:[^/?#]*[.-])?adult-(?:videos?|chat)(?:[.-]|$)": ("adult",)}
    assert {k: rules[k] for k in some} == some
    assert url_filter.literal_tokens("(?i)/Ads/") == ("ads",)
    assert url_filter.literal_tokens("/(?i:Ads)/") == url_filter.literal_tokens("/adS[A-Z]") == url_filter.literal_tokens("a/|b/") == ()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1/.-?", max_size=12), max_size=20))
def test_index_loses_no_rule(urls):
    """Thousands of rules: what the index fetches gives the verdict of trying every rule."""
    words = [f"{a}{b}" for a in "ab1" for b in ("", "a", "b", "1", "ab")]
    rules = [url_filter.PatternRule(p, v) for n in range(90) for w in words for p, v in [(rf"/{w}(?:/|$)", "block"), (rf"[.-]{w}-{n % 7}", "block"), (rf"{w}\.{n}\b", "allow")]]
    index = url_filter.pattern_index(rules)
    for url in urls:
        fits = {r.verdict for r in rules if re.search(r.pattern, url)}
        assert url_filter.pattern_verdict(url, index) == ("block" if fits == {"block"} else "allow")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbSsiıſ1/.-", max_size=12), max_size=20), st.sampled_from(["", "(?i)", "(?x)"]))
def test_flags_and_capitals_lose_no_rule(urls, flags):
    words = ["a", "As", "sI", "AB1", "bS", "i", "s"]
    rules = [url_filter.PatternRule(flags + p.format(w), v) for w in words for p, v in [("/{}/", "block"), ("[.A-]{}-", "block"), ("(?:[/S]|^){}\\b", "allow"), ("-(?i:{})/", "block"), ("/{}[S.]", "block"), ("/{}+/", "allow")]]
    index = url_filter.pattern_index(rules)
    for url in urls:
        fits = {r.verdict for r in rules if re.search(r.pattern, url.lower())}
        assert url_filter.pattern_verdict(url, index) == ("block" if fits == {"block"} else "allow")


def test_a_rule_that_ignores_case_is_fetched():
    index = url_filter.pattern_index([url_filter.PatternRule("(?i)/Ads/")])
    assert set(index) == {"ads"} and url_filter.pattern_verdict("http://x.org/ADS/1", index) == "block"


def test_rule_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# kinds\nblock  /a b$\n\nallow ^x\n")
    assert url_filter.read_rules(spark, str(tmp_path / "rules.txt")) == [url_filter.PatternRule("/a b$"), url_filter.PatternRule("^x", "allow")]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab@.-+_ 0123456789()%", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_luhn_base_stays():
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"pay {card} now")["card"] == [(4, 23)]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("jane [at] corp [dot] org", "email", "jane [at] corp [dot] org"),
        ("j\u200bohn@ex\u0430mple.com!", "email", "j\u200bohn@ex\u0430mple.com"),
        ("card \uff14\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 ok", "card", "\uff14\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11 \uff11\uff11\uff11\uff11"),
        ("call plus four nine one five one two three four five six seven eight now", "phone", "plus four nine one five one two three four five six seven eight"),
        ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("look at this and that one dot", "email", None),
    ],
)
def test_disguises(text, kind, found):
    base, spans = pii.all_spans(text)
    assert [text[a:b] for a, b in spans[kind]] == ([found] if found else [])
    assert all(set(base[k]) <= set(spans[k]) for k in pii.KINDS)


LIKE = {v: k for k, v in reversed(pii.HOMOGLYPHS.items())}
WHOLE = [("email", "john.doe@mail.example.com"), ("email", "x@y.io"), ("ip", "210.14.5.201"), ("card", "4111111111111111"), ("card", "4111 1111-1111 1111"), ("phone", "+1 415 555 0199"), ("phone", "+49 (30) 123-4567")]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(WHOLE), st.sets(st.integers(0, 24), max_size=6), st.sampled_from(["homoglyph", "no width"]), st.sampled_from(["", "Call ", "см. "]), st.sampled_from(["", " now", ", да"]))
def test_a_disguised_character_anywhere_hides_nothing(whole, places, how, before, after):
    kind, said = whole
    hidden = "".join((LIKE.get(c, c) if how == "homoglyph" else f"{c}\u200b" if i + 1 < len(said) else c) if i in places else c for i, c in enumerate(said))
    text = before + hidden + after
    base, spans = pii.all_spans(text)
    assert (len(before), len(before + hidden)) in spans[kind]
    assert set(base[kind]) <= set(spans[kind])
    assert pii.redacted(text, spans) == f"{before}<{kind.upper()}>{after}"  # no fragment is left


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("j\u043ehn@example.com", "email", ["j\u043ehn@example.com", "hn@example.com"]),
        ("john@example.c\u043em", "email", ["john@example.c", "john@example.c\u043em"]),
        ("jane dot doe@example.com", "email", ["jane dot doe@example.com", "doe@example.com"]),
        ("+1 415 555 01 nine nine", "phone", ["+1 415 555 01", "+1 415 555 01 nine nine"]),
        ("+1 415 555 0199 one of us", "phone", ["+1 415 555 0199"]),
        ("look at example.com, it is available at shop.example.org", "email", []),
    ],
)
def test_what_covers_a_base_span(text, kind, found):
    _, spans = pii.all_spans(text)
    assert [text[a:b] for a, b in spans[kind]] == found


@pytest.mark.parametrize("more", ["", " An anecdote.", " [at] the gate"])
def test_an_address_does_not_depend_on_other_words(more):
    text = "write to jane at example.com or bob.b\tAT\tmail.example.org today." + more
    _, spans = pii.all_spans(text)
    assert [text[a:b] for a, b in spans["email"]] == ["jane at example.com", "bob.b\tAT\tmail.example.org"]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("call +1 four one five 555 0199 now", "phone", "+1 four one five 555 0199"),
        ("call plus 1 (four one five) 555-oh one nine nine.", "phone", "plus 1 (four one five) 555-oh one nine nine"),
        ("from one nine two dot 168 dot one dot one.", "ip", "one nine two dot 168 dot one dot one"),
        ("from one nine two [dot] 168 [.] one.1 today", "ip", "one nine two [dot] 168 [.] one.1"),
        ("pay 4111 one 111 one 111 one 111 today", "card", "4111 one 111 one 111 one 111"),
        ("card \uff14111 1111 1111 1111 one", "card", "\uff14111 1111 1111 1111"),
        ("four one one one one one one one one one one one one one one one, 5 apples", "card", "four one one one one one one one one one one one one one one one"),
        ("one of 12 or two 3 and oh well", "card", None),
    ],
)
def test_mixed_digits(text, kind, found):
    _, spans = pii.all_spans(text)
    assert [text[a:b] for a, b in spans[kind]] == ([found] if found else [])


def test_pii_table(spark, docs):
    got = pii.find_pii(clashing(docs))
    for r in got.collect():
        own = tuple(r)[-1]
        assert own["base_sha256"] == hashlib.sha256(pii.told(plain_spans(r.text or "")).encode()).hexdigest()
        assert (own["redacted"] is None) == (r.text is None)
    row = next(tuple(r)[-1] for r in got.collect() if (r.text or "").startswith("mail a.b"))
    assert row["redacted"] == "mail <EMAIL> or <PHONE>, from <IP>"
    assert pii.find_pii(docs.limit(0)).count() == 0


BITS = ["a", "b", " ", "\n", "é", "'s", "1", "  ", "!", "the ", "<|endoftext|>", "\t", "漢", "aa", "\x1c", "\x85", "ʼ", "İ", "×", "\u0301", "T"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=12))
def test_bpe_is_the_librarys(texts):
    spec = read_vocabulary(vocabulary_file("byte_bpe_50k.json"))
    lib = tokenizer(spec)
    for text, (ids, decoded) in zip(texts, bpe.round_trips(texts, spec), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want))
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False)


def test_bpe_table(spark, docs):
    lib = tokenizer(read_vocabulary(vocabulary_file("byte_bpe_50k.json")))
    got = bpe.encode_decode(clashing(docs), with_ids=True)
    for r in got.collect():
        n, ids_sha, decoded_sha, ids, decoded = tuple(r)[-5:]
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        told = ",".join(map(str, want))
        assert (n, ids, ids_sha) == (len(want), told, hashlib.sha256(told.encode()).hexdigest())
        assert decoded == (r.text or "") and decoded_sha == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=14).map("".join), max_size=12))
def test_word_ids_are_the_librarys(texts):
    words = packing.WordIds(read_vocabulary(vocabulary_file("word_bpe_49k.json")))
    for text, raw in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4095), min_size=1, max_size=80))
def test_windows_hold_what_they_can(sizes):
    window = packing.pack(sizes)
    filled = defaultdict(int)
    for w, size in zip(window, sizes, strict=True):
        filled[w] += size
    assert max(filled.values()) <= packing.WINDOW
    assert len(filled) <= 2 * -(-sum(sizes) // packing.WINDOW) + 1


@pytest.mark.parametrize("most", [300, 1500, 4095])
def test_windows_are_nearly_full(most):
    rng = np.random.default_rng(most)
    sizes = rng.integers(1, most + 1, 1000).tolist()
    filled = np.bincount(packing.pack(sizes), weights=sizes)
    assert filled.max() <= packing.WINDOW
    assert len(filled) <= 1.03 * sum(sizes) / packing.WINDOW + 1


def test_packing_table(spark, docs):
    lib = tokenizer(read_vocabulary(vocabulary_file("word_bpe_49k.json")))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])
    rows = packing.pack_documents(clashing(docs)).collect()
    sequences, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        ids = want[r.doc_id][0][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id][0])
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    assert covered == {k: sum(map(len, v)) for k, v in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(docs.limit(0)).count() == 0
