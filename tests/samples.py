"""Files of packed formats, written by hand."""

from __future__ import annotations

import zlib


def pdf(pages, packed=True, table=True, cid=False):
    """A PDF of Courier text; ``pages``: lists of (x, y, text). ``cid``: two-byte codes with a map to text."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 600 800] /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>"]
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /Courier /FirstChar 32 /Widths [" + "600 " * 224 + "] >>"
    first = 4 + 2 * len(pages)
    if cid:
        font = f"<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 600 /W [1 [600] 5 9 600] >>] /ToUnicode {first} 0 R >>"
    streams = {}
    objects.append(font)
    for i, items in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        show = lambda t: "<" + "".join(f"{ord(c):04x}" for c in t) + ">" if cid else "(" + t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ")"
        text = "q 1 0 0 1 0 0 cm BT /F1 10 Tf 12 TL " + " ".join(f"1 0 0 1 {x} {800 - y} Tm {show(t)} Tj" for x, y, t in items) + " ET Q"
        streams[len(objects) + 1] = text.encode("latin-1")
        objects.append("")
    if cid:
        streams[first] = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <00ff> <0000> endbfrange 1 beginbfchar <6bdb> <6bdb> endbfchar"
        objects.append("")
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        if n in streams:
            data = zlib.compress(streams[n]) if packed else streams[n]
            body = f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"
        out += f"{n} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    at = len(out)
    rows = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{rows}".encode() if table else b""
    return out + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at if table else 7}\n%%EOF".encode()


def pdf_of(text, **how):
    """A page with each line of ``text`` at its place, indents as columns."""
    return pdf([[(50 + 6 * (len(line) - len(line.lstrip())), 40 + 14 * i, line.strip()) for i, line in enumerate(text.split("\n")) if line.strip()]], **how)
