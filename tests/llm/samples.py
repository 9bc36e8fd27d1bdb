"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import random

WORDS = "anchor basin canal delta estuary ferry gulf harbour inlet jetty keel lagoon mast north ocean port quay reef shore tide".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


def prose(seed: int, n: int) -> str:
    words = passage(seed, n).split()
    return " ".join(" ".join(words[i : i + 9]).capitalize() + "." for i in range(0, n, 9))


def documents() -> list[tuple]:
    base = [prose(i, 120 + 10 * i) for i in range(6)]
    near = base[0].replace("Anchor", "Anker", 1) if "Anchor" in base[0] else base[0] + " more"
    texts = [*base, base[1].upper(), near, f"{prose(50, 40)} {base[2]}", "", None, "   ", "x", "a b", prose(99, 9000), base[1], "\n\n", "émile Ünder ß", "mail a.b@c.org or +49 30 1234567, from 10.0.0.1"]
    rows = [(i, t, ["en", None, "de"][i % 3], "s", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[9], (None, "no id", None, None, None)]


def clashing(df):
    """``df`` with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "id told keep_id group_size kept text_sha256 size prefix digest host path rule verdict lang_pred score pii n_tokens spans dropped_id".split()
    return df.select("*", *[F.lit("mine").alias(n) for n in names if n not in df.columns])
