"""DuckDB SQL for the column library, as text made from text."""

from __future__ import annotations

from .. import constants as K


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squash(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def spaced(x: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]+', ' ', 'g'))"


def canon_name(x: str) -> str:
    out = f"replace(upper({x}), '&', ' AND ')"
    out = f"regexp_replace({out}, '[.,;:''\"`’_/-]', ' ', 'g')"
    out = strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")
    for pattern, form in K.SUFFIXES:
        out = f"regexp_replace({out}, '{pattern}', '{form}', 'g')"
    return strip(f"regexp_replace({out}, '\\s+', ' ', 'g')")


def lookup(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


def port_parts(x: str) -> tuple[str, str]:
    flat = f"regexp_replace(regexp_replace(regexp_replace(upper({x}), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')"
    place = f"CASE WHEN contains({flat}, ',') THEN {strip(f"regexp_extract({flat}, '(?s)^(.*),([^,]*)$', 1)")} ELSE {flat} END"
    country = f"CASE WHEN contains({flat}, ',') THEN {strip(f"regexp_extract({flat}, '(?s)^(.*),([^,]*)$', 2)")} END"
    return f"coalesce({lookup(f'({place})', K.PORT_ALIASES)}, {place})", f"coalesce({lookup(f'({country})', K.COUNTRY_ALIASES)}, {country})"


def container_count(x: str) -> str:
    u = f"upper({x})"
    pairs = f"regexp_extract_all({u}, '(\\d+)\\s*[X×]', 1)"
    words = f"regexp_extract({u}, '^\\s*({'|'.join(K.NUMBER_WORDS)})\\b', 1)"
    return f"CASE WHEN len({pairs}) > 0 THEN CAST(list_sum(list_transform({pairs}, lambda p: CAST(p AS BIGINT))) AS BIGINT) ELSE coalesce(TRY_CAST(nullif(regexp_extract({u}, '^\\s*(\\d+)\\b', 1), '') AS BIGINT), CAST({lookup(words, K.NUMBER_WORDS)} AS BIGINT)) END"


_WEIGHT = r"(\d[\d.,\s]*)\s*(KGS?|MTS?|TONS?|TONNES?|T|LBS?)?\b"


def weight_kg(x: str) -> str:
    u = strip(f"upper({x})")
    num = f"regexp_replace(replace({strip(f"regexp_extract({u}, '{_WEIGHT}', 1)")}, ' ', ''), '[.,]+$', '')"
    unit = f"coalesce(nullif(regexp_extract({u}, '{_WEIGHT}', 2), ''), 'KG')"
    plain = f"""CASE WHEN contains({num}, ',') AND contains({num}, '.') THEN
      CASE WHEN instr(reverse({num}), ',') < instr(reverse({num}), '.') THEN replace(replace({num}, '.', ''), ',', '.') ELSE replace({num}, ',', '') END
      WHEN contains({num}, ',') THEN CASE WHEN regexp_full_match({num}, '\\d{{1,3}}(,\\d{{3}})+') THEN replace({num}, ',', '') ELSE replace({num}, ',', '.') END
      WHEN contains({num}, '.') AND regexp_full_match({num}, '\\d{{1,3}}(\\.\\d{{3}})+') AND {unit} IN ('KG', 'KGS') THEN replace({num}, '.', '')
      ELSE {num} END"""
    value = f"TRY_CAST(nullif({plain}, '') AS DOUBLE)"
    return f"round(CASE WHEN starts_with({unit}, 'MT') OR starts_with({unit}, 'TON') OR {unit} = 'T' THEN {value} * 1000 WHEN starts_with({unit}, 'LB') THEN {value} * {K.POUND_KG} ELSE {value} END, 3)"


def placeholder(x: str) -> str:
    return f"regexp_matches({x}, {text(K.PLACEHOLDER)})"


def party(x: str) -> tuple[str, str]:
    """Name and principal of a party on one line."""
    pattern = r"(?i)^(.*?)\s+on\s+behalf\s+of\s+(.*)"
    inside = f"regexp_matches({x}, '{pattern}')"
    return f"CASE WHEN {inside} THEN {strip(f"regexp_extract({x}, '{pattern}', 1)")} ELSE {strip(x)} END", f"CASE WHEN {inside} THEN {strip(f"regexp_extract({x}, '{pattern}', 2)")} ELSE '' END"


def verdict(field: str, a: str, b: str) -> str:
    """The verdict on two raw values that were both found."""
    if field in K.PARTIES:
        (an, ab), (bn, bb) = party(a), party(b)
        same = f"{squash(canon_name(an))} = {squash(canon_name(bn))}"
        both = f"{ab} <> '' AND {bb} <> '' AND {squash(canon_name(ab))} <> {squash(canon_name(bb))}"
        rest = f"WHEN {same} AND {both} THEN 'mismatch' WHEN {same} THEN 'match' ELSE 'mismatch'"
    elif field in K.PORTS:
        (ap, ac), (bp, bc) = port_parts(a), port_parts(b)
        own = lambda place, country: f"CASE WHEN {squash(country)} <> {squash(place)} THEN {squash(country)} ELSE '' END"
        same = f"{squash(ap)} = {squash(bp)}"
        both = f"coalesce({own(ap, ac)}, '') <> '' AND coalesce({own(bp, bc)}, '') <> '' AND {squash(ac)} <> {squash(bc)}"
        rest = f"WHEN {same} AND {both} THEN 'mismatch' WHEN {same} THEN 'match' ELSE 'mismatch'"
    else:
        number = container_count if field == "container_count" else weight_kg
        x, y = number(a), number(b)
        same = f"{x} = {y}" if field == "container_count" else f"abs({x} - {y}) <= {K.WEIGHT_TOLERANCE_KG}"
        rest = f"WHEN {x} IS NULL OR {y} IS NULL THEN 'missing' WHEN {same} THEN 'match' ELSE 'mismatch'"
    return f"CASE WHEN {placeholder(a)} OR {placeholder(b)} THEN 'missing' {rest} END"


def clean_body(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), {text(K.BANNER)}, '')")


def category(body: str, subject: str, n: str, ask_send_as: str = "GENERAL") -> str:
    b, s = clean_body(body), f"coalesce({subject}, '')"
    has = lambda x, p: f"regexp_matches({x}, {text(p)})"
    return f"""CASE WHEN {has(b, K.SPAM)} OR {has(s, K.SPAM)} THEN 'SPAM'
      WHEN {has(b, K.COMPARE)} AND NOT {has(b, K.INSTRUCTION_BODY)} THEN 'BL_COMPARISON'
      WHEN {has(b, K.INSTRUCTION_BODY)} AND {has(b, K.INSTRUCTION_POL)} AND {has(b, K.INSTRUCTION_SHIPPER)} THEN 'SI_REQUEST'
      WHEN {has(b, K.ASK_SEND)} THEN '{ask_send_as}'
      WHEN {has(b, K.INVOICE)} THEN 'INVOICE_QUERY'
      WHEN {has(s, K.INVOICE)} AND {has(s, K.INVOICE_SUBJECT)} THEN 'INVOICE_QUERY' ELSE 'GENERAL' END"""


def confidence(body: str, subject: str, n: str) -> str:
    b, s = clean_body(body), f"coalesce({subject}, '')"
    has = lambda x, p: f"regexp_matches({x}, {text(p)})"
    return f"""CASE WHEN {has(b, K.SPAM)} OR {has(s, K.SPAM)} THEN 0.97
      WHEN {has(b, K.COMPARE)} AND NOT {has(b, K.INSTRUCTION_BODY)} THEN CASE WHEN {n} > 0 THEN 0.9 ELSE 0.85 END
      WHEN {has(b, K.INSTRUCTION_BODY)} AND {has(b, K.INSTRUCTION_POL)} AND {has(b, K.INSTRUCTION_SHIPPER)} THEN 0.95
      WHEN {has(b, K.ASK_SEND)} THEN 0.7
      WHEN {has(b, K.INVOICE)} THEN 0.92
      WHEN {has(s, K.INVOICE)} AND {has(s, K.INVOICE_SUBJECT)} THEN 0.6 ELSE 0.8 END"""


def kind(title: str) -> str:
    h = f"regexp_replace(regexp_replace({title}, '[^A-Z/ ]', ' ', 'g'), '\\s+', '', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({h}, '{p}') THEN '{name}'" for p, name in K.TITLES) + " ELSE 'UNKNOWN' END"
