"""The text layer of a PDF file as words with boxes; what becomes of them (rows, lines) is said in Spark.

Only what text needs is read: cross-reference tables and streams (or a scan for objects where they are broken), object
streams, Flate, and the operators that move and show text. Fonts give widths and what their codes mean.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

Word = tuple[str, float, float, float, float]
#: Pages nested in each other, or forms within forms, are followed so deep.
DEPTH = 12
#: A gap of so many ems between two shown texts parts words.
GAP = 0.2

_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)", re.S)
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Names of characters that aren't letters, as fonts call them.
_GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright underscore braceleft bar braceright zero one two three four five six seven eight nine fi fl endash emdash quoteright quoteleft".split(),
    [*" !\"#$%&'()*+,-./:;<=>?@[\\]_{|}0123456789", "fi", "fl", "–", "—", "’", "‘"], strict=True))


class Broken(ValueError):
    """The file isn't a PDF that can be read."""


@dataclass(frozen=True)
class Ref:
    number: int


class Name(str):
    __slots__ = ()


class Key(bytes):
    """An operator or keyword."""

    __slots__ = ()


@dataclass
class Stream:
    head: dict
    data: bytes


class Reader:
    """Values of PDF syntax, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _string(self) -> bytes:
        out, depth = bytearray(), 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                nxt = self.data[self.at : self.at + 1]
                if octal := re.compile(rb"[0-7]{1,3}").match(self.data, self.at):
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                self.at += 1
                if nxt == b"\r" and self.data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                out += b"" if nxt in b"\r\n" else _ESCAPES.get(nxt, nxt)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def value(self):
        """The next value; None at the end. ``n g R`` is a reference."""
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return None
        self.at, t = m.end(), m[1]
        if t == b"(":
            return self._string()
        if t == b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end if end >= 0 else len(self.data)])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t == b"<<":
            out = {}
            while (k := self.value()) is not None and k != b">>":
                v = self.value()
                if isinstance(v, Key) and v == b">>":
                    break
                out[k] = v
            return out
        if t == b"[":
            items = []
            while (v := self.value()) is not None and not (isinstance(v, Key) and v == b"]"):
                items.append(v)
            return items
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1"))
        if t.isdigit() and (r := re.compile(rb"\s+\d+\s+R\b").match(self.data, self.at)):
            self.at = r.end()
            return Ref(int(t))
        try:
            return float(t) if b"." in t else int(t)
        except ValueError:
            return {b"true": True, b"false": False}.get(t, Key(t))


def _unpacked(head: dict, raw: bytes, limit: int = 64 << 20) -> bytes:
    """What a stream holds, at most ``limit`` bytes; of filters only Flate (with row predictors) and hexadecimal digits are known."""
    names, parms = head.get("Filter", []), head.get("DecodeParms", {})
    names, parms = names if isinstance(names, list) else [names], parms if isinstance(parms, list) else [parms]
    for i, name in enumerate(names):
        if name == "FlateDecode":
            raw = zlib.decompressobj().decompress(raw, limit)
            p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
            if p.get("Predictor", 1) >= 10:
                raw = _unpredicted(raw, int(p.get("Columns", 1)) * int(p.get("Colors", 1)) * int(p.get("BitsPerComponent", 8)) // 8)
        elif name == "ASCIIHexDecode":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            return b""
    return raw


def _unpredicted(data: bytes, width: int) -> bytes:
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            left, up = row[i - 1] if i else 0, before[i]
            row[i] = (row[i] + {0: 0, 1: left, 2: up, 3: (left + up) // 2}.get(kind, up)) & 255
        out += row
        before = row
    return bytes(out)


class File:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.held, self.trailer = data, {}, {}, {}, {}
        try:
            self._table(int(re.findall(rb"startxref\s+(\d+)", data)[-1]), set())
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Broken
        except (AttributeError, IndexError, ValueError, TypeError, KeyError, zlib.error):
            self._scan()

    def _table(self, at: int, seen: set[int]) -> None:
        if at in seen:
            return
        seen.add(at)
        if re.compile(rb"\s*xref\b").match(self.data, at):
            reader = Reader(self.data, self.data.index(b"xref", at) + 4)
            while isinstance(first := reader.value(), int):
                for n in range(first, first + reader.value()):
                    place, _, used = reader.value(), reader.value(), reader.value()
                    if used == b"n":
                        self.places.setdefault(n, place)
            head = reader.value()
        else:
            stream = self._at(at)
            head = stream.head
            wide = head["W"]
            rows, step = stream.data, sum(wide)
            index = head.get("Index") or [0, head["Size"]]
            numbers = [n for a, k in zip(index[::2], index[1::2], strict=True) for n in range(a, a + k)]
            for i, n in enumerate(numbers):
                cells, x = [], i * step
                for w in wide:
                    cells.append(int.from_bytes(rows[x : x + w], "big") if w else 1)
                    x += w
                if cells[0] == 1:
                    self.places.setdefault(n, cells[1])
                elif cells[0] == 2 and n not in self.places:
                    self.packed.setdefault(n, cells[1])
        self.trailer = {**head, **self.trailer}
        for key in ("XRefStm", "Prev"):
            if isinstance(head.get(key), int):
                self._table(head[key], seen)

    def _scan(self) -> None:
        """Every object that the file seems to hold, later ones in the place of earlier ones."""
        self.held, self.packed = {}, {}
        self.places = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}
        for m in re.finditer(rb"trailer", self.data):
            if isinstance(head := Reader(self.data, m.end()).value(), dict):
                self.trailer |= head
        for n in list(self.places):
            found = self.get(Ref(n))
            head = found.head if isinstance(found, Stream) else found
            if isinstance(head, dict) and head.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(n)
            elif isinstance(head, dict) and head.get("Type") == "ObjStm":
                self.packed |= {k: n for k in self._members(n) if k not in self.places}

    def _at(self, place: int):
        m = _OBJECT.match(self.data, place) or _OBJECT.search(self.data, place, place + 64)
        if not m:
            raise Broken("no object where the table says")
        reader = Reader(self.data, m.end())
        found = reader.value()
        start = re.compile(rb"\s*stream\r?\n?").match(self.data, reader.at)
        if not isinstance(found, dict) or not start:
            return found
        length = self.get(found.get("Length"))
        end = start.end() + length if isinstance(length, int) else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
            end = self.data.find(b"endstream", start.end())
        plain = {k: self.get(v) for k, v in found.items() if k in ("Filter", "DecodeParms")}
        return Stream(found, _unpacked(plain, self.data[start.end() : end if end >= 0 else len(self.data)]))

    def _members(self, number: int) -> dict[int, int]:
        stream = self.get(Ref(number))
        reader = Reader(stream.data)
        pairs = [(reader.value(), reader.value()) for _ in range(self.get(stream.head["N"]))]
        return {n: self.get(stream.head["First"]) + at for n, at in pairs}

    def get(self, x):
        """``x``, or what it refers to."""
        if not isinstance(x, Ref):
            return x
        if x.number not in self.held:
            self.held[x.number] = None
            if x.number in self.places:
                self.held[x.number] = self._at(self.places[x.number])
            elif x.number in self.packed:
                home = self.packed[x.number]
                self.held[x.number] = Reader(self.get(Ref(home)).data, self._members(home)[x.number]).value()
        return self.held[x.number]

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > DEPTH:
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise Broken("no catalogue")
        walk(root.get("Pages"), {}, 0)
        return out


class Font:
    """Codes to text, and widths in thousandths of an em."""

    def __init__(self, file: File, head: dict):
        get = file.get
        self.wide = head.get("Subtype") == "Type0"
        self.texts: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.usual = 500.0
        if self.wide:
            inner = get((get(head.get("DescendantFonts")) or [{}])[0]) or {}
            self.usual = float(get(inner.get("DW")) or 1000)
            items = [get(x) for x in get(inner.get("W")) or []]
            while len(items) >= 2:
                if isinstance(items[1], list):
                    self.widths |= {items[0] + i: float(get(w)) for i, w in enumerate(items[1])}
                    items = items[2:]
                else:
                    self.widths |= dict.fromkeys(range(items[0], items[1] + 1), float(items[2])) if len(items) > 2 else {}
                    items = items[3:]
        else:
            first = get(head.get("FirstChar")) or 0
            self.widths = {first + i: float(get(w)) for i, w in enumerate(get(head.get("Widths")) or [])}
            coding = get(head.get("Encoding"))
            code = 0
            for x in get(coding.get("Differences")) or [] if isinstance(coding, dict) else []:
                if isinstance(x, Name):
                    named = re.fullmatch(r"u(?:ni)?([0-9A-F]{4,6})", x)
                    self.texts[code] = chr(int(named[1], 16)) if named else _GLYPHS.get(x, x if len(x) == 1 else "�")
                    code += 1
                else:
                    code = x
        told = get(head.get("ToUnicode"))
        if isinstance(told, Stream):
            self._map(told.data)

    def _map(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
            reader, items = Reader(body), []
            while (v := reader.value()) is not None:
                items.append(v)
            step = 2 if kind == b"char" else 3
            for group in zip(*[items[i::step] for i in range(step)], strict=False):
                first, last, to = int.from_bytes(group[0], "big"), int.from_bytes(group[-2], "big"), group[-1]
                for k in range(first, min(last, first + 65535) + 1):
                    if isinstance(to, list):
                        self.texts[k] = text(to[k - first]) if k - first < len(to) else ""
                    else:
                        self.texts[k] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k - first & 0xFFFF).to_bytes(2, "big"))

    def read(self, shown: bytes) -> list[tuple[str, float, bool]]:
        """Text, width in ems, and whether it is the single-byte space, of each code."""
        codes = [int.from_bytes(shown[i : i + 2], "big") for i in range(0, len(shown), 2)] if self.wide else list(shown)
        plain = "�" if self.wide else None
        return [(self.texts.get(c, plain or bytes([c]).decode("cp1252", "replace")), self.widths.get(c, self.usual) / 1000, c == 32 and not self.wide) for c in codes]


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Pen:
    """What text is shown with, and the words it has become; boxes count from the page's upper left corner."""

    top: float
    left: float
    words: list[Word] = field(default_factory=list)
    open_: list | None = None

    def show(self, chars: list[tuple[str, float, bool]], size: float, at: tuple, spread: tuple[float, float, float]) -> tuple:
        extra, between, scale = spread
        for text, width, is_space in chars:
            x, y, em = at[4], at[5], size * (at[2] ** 2 + at[3] ** 2) ** 0.5
            step = (width * size + extra + (between if is_space else 0)) * scale
            right = x + width * size * scale * at[0]
            for char in text or "":
                self._put(char, x - self.left, right - self.left, self.top - y, abs(em))
            at = _times((1, 0, 0, 1, step, 0), at)
        return at

    def _put(self, char: str, x0: float, x1: float, y: float, em: float) -> None:
        w = self.open_
        if w and (char.isspace() or abs(y - w[5]) > 0.3 * em or not -0.5 * em < x0 - w[3] < GAP * em and x0 != w[6]):
            self.close()
            w = None
        if char.isspace():
            return
        if w:
            w[0] += char
            w[3], w[6] = max(w[3], x1), x0
        else:
            self.open_ = [char, x0, y - 0.8 * em, x1, y + 0.2 * em, y, x0]

    def close(self) -> None:
        if self.open_:
            self.words.append(tuple(self.open_[:5]))
        self.open_ = None


def _draw(file: File, content: bytes, resources: dict, pen: Pen, outer: tuple, depth: int) -> None:
    get, stack, states = file.get, [], []
    fonts, forms = (get(get(resources).get(k)) or {} for k in ("Font", "XObject")) if isinstance(get(resources), dict) else ({}, {})
    known: dict[str, Font] = {}
    page, font, size, extra, between, scale, lead, rise = outer, None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
    line = at = _SAME
    reader = Reader(content)

    def shown(data: bytes) -> None:
        nonlocal at
        if font is not None:
            whole = _times(_times((1, 0, 0, 1, 0, rise), at), page)
            end = pen.show(font.read(data), size, whole, (extra, between, scale))
            step = (end[4] - whole[4]) / (whole[0] or 1) if whole[0] else 0
            at = _times((1, 0, 0, 1, step, 0), at)

    while (v := reader.value()) is not None:
        if not isinstance(v, Key):
            stack.append(v)
            continue
        op, args, stack = bytes(v), stack, []
        n = [x for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if op == b"q":
            states.append((page, font, size, extra, between, scale, lead, rise))
        elif op == b"Q" and states:
            page, font, size, extra, between, scale, lead, rise = states.pop()
        elif op == b"cm" and len(n) == 6:
            page = _times(tuple(n), page)
        elif op == b"BT":
            line = at = _SAME
        elif op == b"Tf" and len(args) == 2:
            if args[0] not in known and isinstance(head := get(fonts.get(args[0])), dict):
                known[args[0]] = Font(file, head)
            font, size = known.get(args[0], font), float(args[1])
        elif op in (b"Td", b"TD") and len(n) == 2:
            lead = -n[1] if op == b"TD" else lead
            line = at = _times((1, 0, 0, 1, n[0], n[1]), line)
        elif op == b"Tm" and len(n) == 6:
            line = at = tuple(n)
        elif op == b"T*":
            line = at = _times((1, 0, 0, 1, 0, -lead), line)
        elif op in (b"Tc", b"Tw", b"Tz", b"TL", b"Ts") and n:
            extra, between, scale, lead, rise = (n[0] if op == b"Tc" else extra), (n[0] if op == b"Tw" else between), (n[0] / 100 if op == b"Tz" else scale), (n[0] if op == b"TL" else lead), (n[0] if op == b"Ts" else rise)
        elif op in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            if op == b'"' and len(n) == 2:
                between, extra = n
            if op != b"Tj":
                line = at = _times((1, 0, 0, 1, 0, -lead), line)
            shown(args[-1])
        elif op == b"TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    shown(x)
                elif isinstance(x, (int, float)):
                    at = _times((1, 0, 0, 1, -x / 1000 * size * scale, 0), at)
        elif op == b"Do" and args and depth < DEPTH and isinstance(form := get(forms.get(args[-1])), Stream) and form.head.get("Subtype") == "Form":
            own = get(form.head.get("Matrix")) or _SAME
            _draw(file, form.data, form.head.get("Resources", resources), pen, _times(tuple(own), page), depth + 1)
        elif op == b"BI":  # an image within the text of the page
            end = re.compile(rb"\sEI(?=\s|$)").search(content, reader.at)
            reader.at = end.end() if end else len(content)


def pdf_words(data: bytes) -> list[list[Word]]:
    """Of each page its words (text, and box from the upper left corner), in the order in which they are shown.

    Raises :class:`Broken` where there is no page to read.
    """
    try:
        file = File(data)
        pages = file.pages()
        out = []
        for page in pages:
            box = [float(file.get(x)) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
            parts = file.get(page.get("Contents"))
            parts = [file.get(x) for x in parts] if isinstance(parts, list) else [parts]
            pen = Pen(top=box[3], left=box[0])
            _draw(file, b"\n".join(x.data for x in parts if isinstance(x, Stream)), page.get("Resources", {}), pen, _SAME, 0)
            pen.close()
            out.append(pen.words)
    except (Broken, RecursionError, zlib.error, ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError) as e:
        raise Broken(str(e)) from e
    if not out:
        raise Broken("no pages")
    return out
