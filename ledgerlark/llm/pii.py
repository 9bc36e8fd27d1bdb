"""Personal data: base patterns on the text as it is, and on what offset-preserving transducers make of it.

Three transducers run one after the other over texts that hold something they'd change: homoglyphs (and characters
without width), spelled digits, and at/dot disguises. Each keeps, for every character it writes, the source
characters that it stands for. Identifiers found in the rewritten text are thereby spans of the source. Base spans
always stay. What a rewriting adds may overlap or cover one, as a disguised letter before or after it makes the base
pattern see a part only; it is dropped where it tells no more than base spans of its kind do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .columns import fresh, give_back, in_small_batches, q

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A match of these starts where a run of digits does, so the look-behind and the possessive loops only spare retries.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def find_emails(text: str) -> list[Span]:
    """Goes from one at sign to the next, so a long run of letters costs nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def find_ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.groups())]


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def find_cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]


def find_phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, left to right, end exclusive."""
    numbers = _DIGIT.search(text) is not None
    return {
        "email": find_emails(text),
        "ip": find_ips(text) if numbers else [],
        "card": find_cards(text) if numbers else [],
        "phone": find_phones(text) if numbers and "+" in text else [],
    }


class Tape:
    """A text with, for each of its characters, where its source begins and ends."""

    def __init__(self, text: str, spelled: bool = False):
        """``spelled``: whether digit words are read as digits."""
        self.text, self.starts, self.ends, self.spelled = text, range(len(text)), range(1, len(text) + 1), spelled

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> None:
        """Puts each text in place of a span; spans come left to right. What is written stands for the whole span."""
        out, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[done:a], new]
            starts += [*self.starts[done:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[done:a], *[self.ends[b - 1]] * len(new)]
            done = b
        if done:
            self.text = "".join([*out, self.text[done:]])
            self.starts, self.ends = [*starts, *self.starts[done:]], [*ends, *self.ends[done:]]


def _alphabet(first: int, chars: str) -> dict[str, str]:
    return {chr(first + i): c for i, c in enumerate(chars)}


_AZ = "abcdefghijklmnopqrstuvwxyz"
#: Look-alikes of ASCII characters: full-width forms and styled digits by rule, Cyrillic and Greek letters as fixed values.
HOMOGLYPHS = (
    _alphabet(0xFF01, "".join(map(chr, range(0x21, 0x7F))))
    | {k: v for base in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k, v in _alphabet(base, "0123456789").items()}
    | {k: v for base in (0x1D400, 0x1D5A0, 0x1D670) for k, v in _alphabet(base, _AZ.upper() + _AZ).items()}
    | _alphabet(0x2080, "0123456789") | _alphabet(0x2460, "123456789") | _alphabet(0x0660, "0123456789") | _alphabet(0x06F0, "0123456789")
    | dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789", strict=True))
    | dict(zip("аеорсухіјѕԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijsdqwABEKMHOPCTXIJS", strict=True))
    | dict(zip("οανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpABEZHIKMNOPTYX", strict=True))
    | dict(zip("․。﹒·﹫‐‑‒–—−    ", "....@------    ", strict=True))
)
_ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "­​-‍⁠﻿]")

DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SIGNS = {"dot": ".", "point": ".", "plus": "+", "dash": "-", "hyphen": "-"}
_WORD = "|".join(DIGIT_WORDS)
_ANY_WORD = re.compile(rf"(?i)\b(?:{_WORD})\b")
#: What may lie between two digits that are read as one run: a sign's word, a bracketed or plain point, or separators.
_GAP = r"(?:[\s,(\[{<-]++(?:dot|point|dash|hyphen)[\s,)\]}>-]++|\s*+[\[({<]\s*+\.\s*+[\])}>]\s*+|[\s,()-]++|\.)"


def _run_of(unit: str) -> re.Pattern:
    return re.compile(rf"(?i)(?:\bplus\s+)?\b{unit}\b(?:{_GAP}\b{unit}\b)+")


#: Two digits at least: of digit words alone, and of digit words and numerals together.
_WORDS_ALONE, _MIXED = _run_of(f"(?:{_WORD})"), _run_of(f"(?:{_WORD}|[0-9]++)")
_UNIT = re.compile(rf"(?i)\b(?:{_WORD}|[0-9]++)\b")
_SIGN = re.compile(r"(?i)dot|point|dash|hyphen|\.")

_LABEL = "[A-Za-z0-9-]+"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|@)"
#: A whole disguised address: a local part, an at of any form, and labels of which the last is of letters.
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,8}}{_AT}(?:{_LABEL}(?:\.|{_DOT}))+[A-Za-z]{{2,24}}(?![A-Za-z0-9])")
_DISGUISE = re.compile(rf"(?i)(?P<dot>{_DOT})|(?P<at>{_AT})")
_NUMERIC_DOT = re.compile(rf"(?i)(?<=[0-9]){_DOT}(?=[0-9])")
_BRACKET = re.compile(r"(?i)[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
#: What an address has that is disguised by the bare word at alone; any other has the letters dot or a bracket.
_BARE_AT = re.compile(rf"(?i)\sat\s+{_LABEL}\.")
#: Words before a bare "at" and a plain host name that speak of the site, not of a mailbox there.
_NO_MAILBOX = frozenset("look looking us me you them here there available found find online website site page pages visit more read shop buy order book posted published hosted live see is are was were it store stay video listed registered only now today details".split())


def _spelled_edits(text: str, runs: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """Digits for the digit words of each run that has any, and signs or nothing for what parts them from their neighbours."""
    for run in runs.finditer(text):
        if not _ANY_WORD.search(run[0]):
            continue
        before = None
        for m in _UNIT.finditer(text, *run.span()):
            digit = DIGIT_WORDS.get(m[0].lower())
            if before is not None:
                gap = text[before[0] : m.start()]
                sign = _SIGN.search(gap)
                if sign and gap != ".":
                    yield before[0], m.start(), _SIGNS.get(sign[0].lower(), ".")
                elif not sign and (digit or before[1]):
                    yield before[0], m.start(), ""
            elif m.start() > run.start():
                yield run.start(), m.start(), "+"
            if digit:
                yield m.start(), m.end(), digit
            before = m.end(), digit


def _disguise_edits(text: str) -> Iterator[tuple[int, int, str]]:
    edits = {m.span(): "." for m in _NUMERIC_DOT.finditer(text)}
    for address in _ADDRESS.finditer(text):
        parts = list(_DISGUISE.finditer(text, *address.span()))
        if len(parts) == 1 and text[address.start() : parts[0].start()].lower() in _NO_MAILBOX:
            continue
        if any(m["dot"] or m[0] != "@" for m in parts):
            ats = [m for m in parts if m["at"]]
            edits |= {m.span(): "." for m in parts if m["dot"]} | {m.span(): "@" for m in ats[-1:]}
    for (a, b), new in sorted(edits.items()):
        yield a, b, new


def _normalised(text: str, runs: re.Pattern | None) -> Tape:
    """What the transducers make of ``text`` with the spelled digits of such runs."""
    tape = Tape(text, runs is not None)
    if not text.isascii() and _ODD.search(text):
        tape.rewrite((m.start(), m.end(), HOMOGLYPHS.get(m[0], "")) for m in _ODD.finditer(text))
    if runs is not None:
        tape.rewrite(_spelled_edits(tape.text, runs))
    if "dot" in tape.text.lower() or _BRACKET.search(tape.text) or _BARE_AT.search(tape.text):
        tape.rewrite(_disguise_edits(tape.text))
    return tape


def readings(text: str) -> list[Tape]:
    """What the transducers make of ``text``: with no spelled digit read, those of words alone, and those of mixed runs.

    A word beside an identifier ("4111 1111 1111 1111 one") may belong to it or not, so each reading counts. Readings
    that are alike count once, those that change nothing not at all.
    """
    tapes = [_normalised(text, None)]
    if _ANY_WORD.search(text if text.isascii() else tapes[0].text):
        tapes += [_normalised(text, runs) for runs in (_WORDS_ALONE, _MIXED)]
    return list({t.text: t for t in tapes if t.text != text}.values())


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    return [s for s in spans if all(s[1] <= t[0] or t[1] <= s[0] for t in taken)]


def _tells_more(span: Span, base: list[Span], text: str, spelled: bool) -> bool:
    """Whether a revealed span says more than base spans of its kind.

    One that overlaps none does, and one that reaches beyond those it overlaps; but a single digit word beside an
    identifier that is whole without it ("+1 415 555 0199 one of us") is taken for a word.
    """
    over = [s for s in base if s[0] < span[1] and span[0] < s[1]]
    if not over:
        return True
    outside = [text[span[0] : max(span[0], over[0][0])], text[min(span[1], over[-1][1]) : span[1]]]
    if not any(outside):
        return False
    return not spelled or sum(len(_ANY_WORD.findall(x)) for x in outside) != 1


def _longest(spans: set[Span]) -> list[Span]:
    """Of spans that overlap the longest."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        kept += _free([s], kept)
    return kept


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those that the transducers reveal, by kind and in order."""
    base = base_spans(text)
    tapes = readings(text)
    if not tapes:
        return base, base
    revealed: dict[str, set[Span]] = {k: set() for k in KINDS}
    for tape in tapes:
        for k, spans in base_spans(tape.text).items():
            found = [(tape.starts[a], tape.ends[b - 1]) for a, b in spans]
            revealed[k] |= {s for s in found if _tells_more(s, base[k], text, tape.spelled)}
    return base, {k: sorted([*base[k], *_longest(revealed[k])]) for k in KINDS}


def told(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by kind, then start, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """``text`` with each span replaced by its kind, as ``<EMAIL>``; spans that overlap become one, of the first's kind."""
    out, end, last = [], 0, len(text)
    merged: list[list] = []
    for a, b, k in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[end:a], f"<{k.upper()}>"]
        end = b
    return "".join([*out, text[end:last]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find_pii(df: DataFrame, text_col: str = "text", result_col: str = "pii") -> DataFrame:
    """Every row of ``df`` with a struct of counts and digest of base spans, all spans, and the redacted text.

    Defined cases: a null text counts as empty (no span; redacted text null); texts of any length are read whole;
    repeated rows are read one by one; an empty table gives an empty result; a taken name gets an underscore.
    """

    @F.pandas_udf(FOUND)
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, spans = all_spans(text or "")
                digest = hashlib.sha256(told(base).encode()).hexdigest()
                rows.append((*(len(base[k]) for k in KINDS), digest, told(spans), redacted(text, spans) if text else text))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])
        give_back()

    (name,) = fresh(df, result_col)
    return in_small_batches(df).withColumn(name, spans_of(q(text_col)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_pii(docs).select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", "pii.base_sha256", "pii.spans")
