"""Canonical forms that take formatting out of names, ports, counts and weights and leave real differences in."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COUNTRY_ALIASES, NUMBER_WORDS, PORT_ALIASES, POUND_KG, SUFFIXES
from .text import let, single_spaced, strip, stripped, tidy


def lookup(c: Column, table: dict) -> Column:
    """The entry of ``c``, null without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


#: What each of SUFFIXES can't match without; those of the first two are met most.
_WORDS = ["LIMITED", "COMPANY", "CORPORATION", "INCORPORATED", "BHD", "PRIVATE", "LLC"]


def name_spaced(up: Column) -> Column:
    """A company's name, given in capitals, with spaces for punctuation."""
    out = F.replace(up, F.lit("&"), F.lit(" AND "))
    for mark in ".,;:'\"`’_/-":
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def name_forms(base: Column) -> Column:
    """A tidy name in capitals with company forms in one spelling. Only forms whose letters occur are tried."""

    def respelled(pairs: list[tuple[str, str]]) -> Column:
        out = base
        for pattern, form in pairs:
            out = F.regexp_replace(out, pattern, form)
        return strip(single_spaced(out))

    has = lambda words: reduce(or_, [base.contains(w) for w in words])
    return F.when(has(_WORDS[2:]), respelled(SUFFIXES)).when(has(_WORDS[:2]), respelled(SUFFIXES[:2])).otherwise(base)


def canon_name(c: Column) -> Column:
    """A company's name in capitals, punctuation as single spaces, company forms in one spelling."""
    return let(name_spaced(F.upper(c)), lambda spaced: let(tidy(spaced), name_forms))


def without_brackets(up: Column) -> Column:
    return F.when(up.contains("("), F.regexp_replace(up, r"\([^)]*\)", " ")).otherwise(up)


def without_ends(tidied: Column) -> Column:
    """A tidy text without spaces and commas at its ends."""
    outer = F.substring(tidied, 1, 1).isin(" ", ",") | F.substring(tidied, -1, 1).isin(" ", ",")
    return F.when(outer, F.regexp_replace(tidied, "^[ ,]+|[ ,]+$", "")).otherwise(tidied)


def port_parts(flat: Column) -> tuple[Column, Column]:
    """What stands before the last comma of a flat port, and what follows it; null where there is none."""
    comma, last = flat.contains(","), F.substring_index(flat, ",", -1)
    before = F.when(comma, F.substring(flat, F.lit(1), F.length(flat) - F.length(last) - 1)).otherwise(flat)
    # Of a tidy text only spaces can be at the ends of its parts.
    return F.trim(before), F.when(comma, F.trim(last))


def port_names(place: Column, country: Column) -> tuple[Column, Column]:
    return F.coalesce(lookup(place, PORT_ALIASES), place), F.coalesce(lookup(country, COUNTRY_ALIASES), country)


def canon_port(c: Column) -> Column:
    """``place, country``: codes and terminals in brackets dropped, the country is what follows the last comma."""
    pair = lambda place, country: F.struct(place.alias("place"), country.alias("country"))
    flat = let(let(let(F.upper(c), without_brackets), tidy), without_ends)
    return let(flat, lambda f: let(pair(*port_parts(f)), lambda p: pair(*port_names(p["place"], p["country"]))))


def multiples(text: Column) -> Column:
    """Numbers before an ``x``, of a text in capitals."""
    return F.regexp_extract_all(text, F.lit(r"(\d+)\s*[X×]"), F.lit(1))


def counted(text: Column, pairs: Column) -> Column:
    """Sum of ``pairs`` (see :func:`multiples`); else the number, or the number word, that the text begins with."""
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x.try_cast("long"))
    first = F.nullif(F.regexp_extract(text, r"^\s*(\d+)\b", 1), F.lit("")).try_cast("long")
    word = F.regexp_extract(text, rf"^\s*({'|'.join(NUMBER_WORDS)})\b", 1)
    one = F.get(pairs, F.lit(0)).try_cast("long")
    return F.when(F.size(pairs) == 1, one).when(F.size(pairs) > 1, total).otherwise(F.coalesce(first, lookup(word, NUMBER_WORDS).cast("long")))


def container_count(c: Column) -> Column:
    """Sum of the numbers before an ``x``; else the number, or the number word, that the text begins with."""
    return let(F.upper(c), lambda text: let(multiples(text), lambda pairs: counted(text, pairs)))


#: Fixed value: a number run and a unit of weight.
_WEIGHT = r"(\d[\d.,\s]*)\s*(KGS?|MTS?|TONS?|TONNES?|T|LBS?)?\b"


def weight_parts(text: Column) -> tuple[Column, Column]:
    """Number and unit of the first weight of a stripped text in capitals."""
    return F.regexp_extract(text, _WEIGHT, 1), F.regexp_extract(text, _WEIGHT, 2)


def weight_digits(number: Column) -> Column:
    """A weight's number without spaces, nor points and commas at its end."""
    bare = F.replace(stripped(number), F.lit(" "), F.lit(""))
    return F.regexp_replace(bare, "[.,]+$", "")


def plain_number(number: Column, unit: Column) -> Column:
    """A weight's digits as a double: a lone separator before three digits is one of thousands for kg, which no unit means too."""
    comma, dot = number.contains(","), number.contains(".")
    by_comma = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    by_dot = F.replace(number, F.lit(","), F.lit(""))
    comma_last = F.instr(F.reverse(number), ",") < F.instr(F.reverse(number), ".")
    plain = (
        F.when(comma & dot, F.when(comma_last, by_comma).otherwise(by_dot))
        .when(comma, F.when(number.rlike(r"^\d{1,3}(,\d{3})+$"), by_dot).otherwise(F.replace(number, F.lit(","), F.lit("."))))
        .when(dot & number.rlike(r"^\d{1,3}(\.\d{3})+$") & unit.isin("", "KG", "KGS"), F.replace(number, F.lit("."), F.lit("")))
        .otherwise(number)
    )
    return F.when(number != "", plain).try_cast("double")


def in_kg(value: Column, unit: Column) -> Column:
    tons = unit.startswith("MT") | unit.startswith("TON") | (unit == "T")
    return F.round(F.when(tons, value * 1000).when(unit.startswith("LB"), value * POUND_KG).otherwise(value), 3)


def weight_kg(c: Column) -> Column:
    """The first number with its unit, in kg."""
    pair = lambda number, unit: F.struct(number.alias("number"), unit.alias("unit"))
    parts = let(strip(F.upper(c)), lambda text: pair(*weight_parts(text)))
    digits = let(parts, lambda p: pair(weight_digits(p["number"]), p["unit"]))
    return let(digits, lambda p: let(plain_number(p["number"], p["unit"]), lambda v: in_kg(v, p["unit"])))
