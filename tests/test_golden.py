"""Verdicts on inboxes whose results are known: folders named in LEDGERLARK_GOLDEN (parted by colons).

Each has ``inbox``, ``attachments`` and ``expected.md``, a table of id, result and what needs attention. Messages of which
an attachment is missing or isn't text are left out, as their results rest on other programs.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import pytest

from ledgerlark.plans import reconcile as P

FOLDERS = [f for f in os.environ.get("LEDGERLARK_GOLDEN", "").split(":") if f]


def expected(folder: Path) -> dict[str, tuple]:
    out = {}
    for line in (folder / "expected.md").read_text().split("\n"):
        m = re.match(r"\| (email_\w+) \| (.*?) \| (.*) \|$", line)
        if not m:
            continue
        review = re.match(r"NEEDS REVIEW \((\w+)\)", m[2])
        status = "NEEDS_REVIEW" if review else "MISMATCH" if m[2] == "MISMATCH" else "OK"
        out[m[1]] = (status, review[1] if review else None, sorted(re.findall(r"\*\*(\w+)\*\*", m[3])) if status == "MISMATCH" else [])
    return out


def text_only(folder: Path) -> set[str]:
    mails = [json.loads(p.read_text()) for p in (folder / "inbox").glob("email_*.json")]
    return {m["email_id"] for m in mails if all(a.endswith(".txt") and (folder / a).exists() for a in m["attachments"])}


@pytest.mark.skipif(not FOLDERS, reason="LEDGERLARK_GOLDEN isn't set")
@pytest.mark.parametrize("folder", FOLDERS)
def test_known_verdicts(spark, folder):
    want, some = expected(Path(folder)), text_only(Path(folder))
    got = {r.email_id: (r.status, r.review_reason, sorted(r.defect_fields)) for r in P.reconcile_folder(spark, folder).collect() if r.category == "BL_COMPARISON"}
    both = sorted(set(want) & some)
    wrong = {i: (got.get(i), want[i]) for i in both if got.get(i) != want[i]}
    print(f"{len(both) - len(wrong)} of {len(both)} agree")
    assert both and not wrong
    assert set(got) & some == set(both)  # nothing else is taken for a comparison
