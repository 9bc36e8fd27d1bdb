"""Field by field comparison with four outcomes, and the status they roll up to.

All seven verdicts are columns of one row, so a message needs no shuffle beyond the one that brings its two documents
together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.normalise import (
    canon_name, canon_port, container_count, counted, in_kg, multiples, name_forms, name_spaced, plain_number, port_names, port_parts, weight_digits, weight_kg, weight_parts, without_brackets, without_ends,
)
from ..functions.similarity import squashed_ratio
from ..functions.text import general, let, quoted, squash, stripped, tidy
from .alike import likely_pairs
from .dealing import dealt, once
from .extract import behalf_below, correction, first_line, party_lines, split_behalf

Values = dict[str, Column]
RESULT_TYPE = "struct<field:string,verdict:string,si:string,bl:string,reason:string,si_evidence:string,bl_evidence:string>"


def normal_value(name: str, field: Column, snaps: Column | None = None) -> Column:
    """``text, more, number``: a party's name and principal, a port's place and country, or a number.

    ``snaps`` (``names, places``: maps, see :func:`snapped`) puts known entries in the place of what a scan says. The
    country beside a known place doesn't count.
    """
    none = F.lit(None).cast("string")

    def value(text: Column, more: Column, number: Column) -> Column:
        return F.struct(text.cast("string").alias("text"), more.cast("string").alias("more"), number.cast("double").alias("number"))

    if name in K.PARTIES:
        known = (lambda text: text) if snaps is None else lambda text: let(text, lambda x: F.coalesce(F.try_element_at(snaps["names"], x), x))
        found = let(party_lines(field), lambda p: value(known(canon_name(p["name"])), F.when(p["behalf"] != "", canon_name(p["behalf"])), F.lit(None)))
    elif name in K.PORTS:
        entry = lambda p: none if snaps is None else F.try_element_at(snaps["places"], p["place"])
        country = lambda p: F.when(entry(p).isNull() & (squash(p["country"]) != squash(p["place"])), p["country"])
        found = let(canon_port(field["raw"]), lambda p: value(F.coalesce(entry(p), p["place"]), country(p), F.lit(None)))
    elif name == "container_count":
        found = value(none, none, container_count(field["raw"]))
    else:
        found = value(none, none, weight_kg(field["raw"]))
    return F.when(field.isNotNull(), found)


def kind_of(name: str) -> str:
    return "party" if name in K.PARTIES else "port" if name in K.PORTS else "count" if name == "container_count" else "weight"


def value_of_kind(kind: Column, field: Column, snaps: Column | None = None) -> Column:
    """:func:`normal_value` of a field whose kind is a column."""
    chain = F
    for name in ("shipper", "port_of_loading", "container_count", "gross_weight_kg"):
        chain = chain.when(kind == kind_of(name), normal_value(name, field, snaps))
    return chain


def _verdict(verdict: str, reason: Column | str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def decide(kind: str, name: Column, si: Column | Values, bl: Column | Values, a: Column | Values, b: Column | Values, scanned: Column, si_stable: Column, bl_stable: Column, likeness: Column) -> Column:
    """``verdict, reason`` of one field, of fields ``si``, ``bl`` and their normal values ``a``, ``b`` (structs, or columns by name).

    ``likeness`` is null where both texts are the same but for what isn't a letter or digit.
    """
    chain = F
    for side, field in (("SI", si), ("BL", bl)):
        chain = chain.when(field["none"] if isinstance(field, dict) else field.isNull(), _verdict("missing", F.concat(F.lit(f"{side} has no '"), name, F.lit("' field"))))
        chain = chain.when(field["blank"], _verdict("missing", F.concat(F.lit(f"{side} value is blank/placeholder ("), quoted(field["raw"]), F.lit(")"))))
    chain = chain.when(~si_stable, _verdict("uncertain", "OCR passes disagree on the SI value"))
    chain = chain.when(~bl_stable, _verdict("uncertain", "OCR passes disagree on the BL value"))
    match = _verdict("match", "")
    if kind in ("party", "port"):
        percent = F.bround(likeness, 0).cast("int").cast("string")
        near = scanned & (likeness >= K.NEAR_MISS)
        both = (F.coalesce(a["more"], F.lit("")) != "") & (F.coalesce(b["more"], F.lit("")) != "") & (squash(a["more"]) != squash(b["more"]))
        versus = F.concat(a["more"], F.lit(" vs "), b["more"], F.lit(")"))
        if kind == "party":
            chain = chain.when(a["text"].isNull() | b["text"].isNull(), _verdict("missing", "party name empty"))
        differs = "'on behalf of' party differs (" if kind == "party" else "same place name, different country ("
        what = "names" if kind == "party" else "port names"
        other = F.concat(F.lit("different party (similarity "), percent, F.lit(")")) if kind == "party" else "different port"
        return (
            chain.when(likeness.isNull() & both, _verdict("mismatch", F.concat(F.lit(differs), versus)))
            .when(likeness.isNull(), match)
            .when(near, _verdict("uncertain", F.concat(F.lit(f"{what} differ slightly (similarity "), percent, F.lit(") - could be OCR noise"))))
            .otherwise(_verdict("mismatch", other))
        )
    x, y = a["number"], b["number"]
    same = x == y if kind == "count" else F.abs(x - y) <= K.WEIGHT_TOLERANCE_KG
    return chain.when(x.isNull() | y.isNull(), _verdict("missing", "could not parse a number")).when(same, match).otherwise(_verdict("mismatch", F.concat(general(x), F.lit(" vs "), general(y))))


def consensus(kind: Column, name: Column, passes: Column, snaps: Column | None = None) -> Column:
    """``field, stable`` of several readings: the first there is, and whether all have one normal value."""
    values = F.transform(passes, lambda p: let(F.try_element_at(p, name), lambda f: F.coalesce(F.to_json(F.when(~f["blank"], value_of_kind(kind, f, snaps))), F.lit("-"))))
    first = F.get(F.filter(F.transform(passes, lambda p: F.try_element_at(p, name)), lambda f: f.isNotNull()), F.lit(0))
    return F.struct(first.alias("field"), (F.size(F.array_distinct(values)) == 1).alias("stable"))


def table_note(lines: Column, fields: Column) -> Column:
    """What is wrong where the rows of a container table aren't as many as the document states; else null."""
    rows = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[A-Z]{4}\d{7}\b")))
    field = F.try_element_at(fields, F.lit("container_count"))
    stated = F.when(~field["blank"], container_count(field["raw"]))
    return F.when((rows > 0) & (stated != rows), F.concat(F.lit("document lists "), rows.cast("string"), F.lit(" container rows but states "), stated.cast("string")))


def compare_documents(rows: DataFrame, corrections: str | None = None, result: str = "fields", snaps: str | None = None, key: str | None = None) -> DataFrame:
    """``rows`` (dealt by ``key`` to all cores first, if it is named) with an array of seven results, in the fields' order; null where ``si`` or ``bl`` is.

    ``si``, ``bl``: structs ``fields, pass_fields, ocr, lines, kind`` of the two documents. ``corrections``: the name
    of a column, a struct ``si, bl`` of maps; ``snaps``: of one as :func:`snapped` makes it, which counts for scanned
    documents alone. Normal forms are made in stages of plain columns, which Spark compiles; only what scans alone need
    (the consensus of several readings) is a function on arrays. Filters on what follows from it don't compare again.
    """
    rows = rows if key is None else dealt(rows, key)
    own = rows.columns
    si, bl = F.col("si"), F.col("bl")
    known = {side: None if snaps is None else F.when(F.col(side)["ocr"], F.col(snaps)) for side in ("si", "bl")}
    fixed = F.lit(False) if corrections is None else F.col(corrections).isNotNull()
    note = let(
        F.struct(table_note(si["lines"], si["fields"]).alias("a"), table_note(bl["lines"], bl["fields"]).alias("b")),
        lambda n: F.coalesce(F.concat(si["kind"], F.lit(": "), n["a"]), F.concat(bl["kind"], F.lit(": "), n["b"])),
    )
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kind_of(n)).alias("kind")) for n in K.FIELDS])

    def agreed(side: str) -> Column:
        doc = F.col(side)
        several = doc["ocr"] & doc["pass_fields"].isNotNull() & ~fixed
        return F.when(several, F.transform(names, lambda x: consensus(x["kind"], x["name"], doc["pass_fields"], known[side])))

    def read(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        passes = F.col(f"{side}_passes")
        found = F.when(passes.isNotNull(), passes[i]["field"]).otherwise(F.try_element_at(F.col(side)["fields"], F.lit(name)))
        stable = F.coalesce(passes[i]["stable"], F.lit(True))
        if corrections is not None:
            entered = F.try_element_at(F.col(corrections)[side], F.lit(name))
            found, stable = F.when(entered.isNotNull(), correction(entered)).otherwise(found), entered.isNotNull() | stable
        return {"field": found, "stable": stable}

    # What later columns use more than once is a column of its own: Spark works it out once, and compiles it. Patterns are
    # for the few texts that plain functions on their bytes don't settle.
    wide = rows.select("*", (si["ocr"] | bl["ocr"]).alias("scanned_"), (si.isNotNull() & bl.isNotNull()).alias("both_"), note.alias("note_"), *[agreed(side).alias(f"{side}_passes") for side in ("si", "bl")])
    part = lambda side, i, what: F.col(f"{side}{i}_{what}")
    each = [(side, i, name, kind_of(name)) for side in ("si", "bl") for i, name in enumerate(K.FIELDS)]

    def stage(df: DataFrame, columns: Callable[[str, int, str, str], dict[str, Column]]) -> DataFrame:
        """``df`` with ``columns`` of each side and field; those that nothing uses any more Spark leaves out."""
        return df.select("*", *[c.alias(f"{side}{i}_{what}") for side, i, name, kind in each for what, c in columns(side, i, name, kind).items()])

    def lines(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        field = part(side, i, "field")
        out = {what: field[what] for what in ("raw", "blank", "evidence")} | {"none": field.isNull()}
        return out | ({"line": first_line(field), "below": behalf_below(field)} if kind == "party" else {"up": F.upper(field["raw"])})

    def parts(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if kind == "party":
            return dict(zip(("said", "behalf_said"), split_behalf(part(side, i, "line"), part(side, i, "below")), strict=True))
        up = part(side, i, "up")
        return {"open": without_brackets(up)} if kind == "port" else {"pairs": multiples(up)} if kind == "count" else dict(zip(("digits_said", "unit"), weight_parts(up), strict=True))

    def spaced(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if kind == "party":
            said, behalf = part(side, i, "said"), part(side, i, "behalf_said")
            return {"name": stripped(said), "spaced": name_spaced(F.upper(said)), "behalf_spaced": F.when(behalf != "", name_spaced(F.upper(behalf)))}
        if kind == "port":
            return {"tidy": tidy(part(side, i, "open"))}
        return {"number": counted(part(side, i, "up"), part(side, i, "pairs")).cast("double")} if kind == "count" else {"digits": weight_digits(part(side, i, "digits_said"))}

    def halves(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if kind == "party":
            return {"base": tidy(part(side, i, "spaced")), "behalf_base": tidy(part(side, i, "behalf_spaced"))}
        return {"flat": without_ends(part(side, i, "tidy"))} if kind == "port" else {} if kind == "count" else {"value": plain_number(part(side, i, "digits"), part(side, i, "unit"))}

    def named(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if kind == "party":
            more = part(side, i, "behalf_base")
            return {"text": name_forms(part(side, i, "base")), "more": F.when(more != "", name_forms(more))}
        if kind == "port":
            return dict(zip(("place", "country"), port_parts(part(side, i, "flat")), strict=True))
        return {"number": in_kg(part(side, i, "value"), part(side, i, "unit"))} if kind == "weight" else {}

    def snap(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if kind == "party":
            text = part(side, i, "text")
            return {"known": text if known[side] is None else F.coalesce(F.try_element_at(known[side]["names"], text), text)}
        if kind == "port":
            text, more = port_names(part(side, i, "place"), part(side, i, "country"))
            entry = F.lit(None).cast("string") if known[side] is None else F.try_element_at(known[side]["places"], text)
            return {"known": F.coalesce(entry, text), "more": more, "text": text, "snapped": entry.isNotNull()}
        return {}

    def letters(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        """Where both sides have one text their letters are the same, and where they have one country it doesn't tell them apart."""
        if kind not in ("party", "port"):
            return {}
        both = lambda what: part("si", i, what).eqNullSafe(part("bl", i, what))
        out = {"letters": F.when(~both("known"), F.coalesce(squash(part(side, i, "known")), F.lit("")))}
        more = part(side, i, "more")
        own = part("si", i, "more").isNotNull() & part("bl", i, "more").isNotNull() & ~both("more")
        return out | {"other": F.when(own & ~part(side, i, "snapped") & (squash(more) != squash(part(side, i, "text"))), more) if kind == "port" else more}

    def likeness(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if side == "bl" or kind not in ("party", "port"):
            return {}
        a, b = part("si", i, "letters"), part("bl", i, "letters")
        # Of ports nobody is told how alike they are; it only counts for scans.
        told = squashed_ratio(a, b) if kind == "party" else F.when(F.col("scanned_"), squashed_ratio(a, b)).otherwise(0.0)
        return {"likeness": F.when(a != b, told)}

    def judged(side: str, i: int, name: str, kind: str) -> dict[str, Column]:
        if side == "bl":
            return {}
        values = lambda side: {"text": part(side, i, "known"), "more": part(side, i, "other")} if kind in ("party", "port") else {"number": part(side, i, "number")}
        like = part("si", i, "likeness") if kind in ("party", "port") else F.lit(None)
        fields = [{what: part(side, i, what) for what in ("raw", "blank", "none")} for side in ("si", "bl")]
        return {"told": decide(kind, F.lit(name), *fields, values("si"), values("bl"), F.col("scanned_"), part("si", i, "stable"), part("bl", i, "stable"), like)}

    def shown(side: str, i: int, kind: str) -> Column:
        """A party's name without its principal; else the value as it is written."""
        raw = part(side, i, "raw")
        return F.when(part(side, i, "name") != "", part(side, i, "name")).otherwise(raw) if kind == "party" else raw

    def result_of(i: int, name: str, kind: str) -> Column:
        t, evidence = part("si", i, "told"), lambda side: F.coalesce(part(side, i, "evidence"), F.lit(""))
        verdict, reason = t["verdict"], t["reason"]
        if kind == "count":
            demoted = (verdict == "match") & F.col("note_").isNotNull()
            verdict, reason = F.when(demoted, "uncertain").otherwise(verdict), F.when(demoted, F.col("note_")).otherwise(reason)
        return F.struct(
            F.lit(name).alias("field"), verdict.alias("verdict"), shown("si", i, kind).alias("si"), shown("bl", i, kind).alias("bl"),
            reason.alias("reason"), evidence("si").alias("si_evidence"), evidence("bl").alias("bl_evidence"),
        )

    for columns in (read, lines, parts, spaced, halves, named, snap, letters, likeness, judged):
        wide = stage(wide, columns)
    results = F.array(*[result_of(i, n, kind_of(n)) for i, n in enumerate(K.FIELDS)])
    return once(wide, result, F.when(F.col("both_"), results)).select(*[c for c in own if c != result], result)


def roll_up(fields: Column, scanned: Column | None = None) -> Column:
    """``status, review_reason, review_detail, has_defect, defect_fields`` of seven results.

    A mismatch counts even where other fields wait for a person; a missing value counts more than an uncertain one.
    ``scanned`` (None for uploads): whether what is only uncertain is told as unreadable.
    """
    of = lambda v: F.filter(fields, lambda f: f["verdict"] == v)
    wrong, missing, unsure = of("mismatch"), of("missing"), of("uncertain")
    pending = F.concat(missing, unsure)
    told = F.array_join(F.transform(pending, lambda f: F.concat(f["field"], F.lit(": "), f["reason"])), "; ")
    also = F.concat(F.lit("also needs a person: "), F.array_join(F.transform(pending, lambda f: F.concat(f["field"], F.lit(" ("), f["reason"], F.lit(")"))), ", "))
    some = F.size(wrong) > 0
    unsure_reason = F.lit("missing_value") if scanned is None else F.when(scanned, "unreadable").otherwise("missing_value")
    return F.struct(
        F.when(some, "MISMATCH").when(F.size(pending) > 0, "NEEDS_REVIEW").otherwise("OK").alias("status"),
        F.when(some, None).when(F.size(missing) > 0, "missing_value").when(F.size(unsure) > 0, unsure_reason).alias("review_reason"),
        F.when(some & (F.size(pending) > 0), also).when(~some & (F.size(pending) > 0), told).alias("review_detail"),
        some.alias("has_defect"),
        F.transform(wrong, lambda f: f["field"]).alias("defect_fields"),
    )


def vocabulary(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``kind (name or place), entry``: distinct names and places of documents that were born digital (dealt by ``key`` first, if it is named).

    Places, and names without whom they act for (of which there are far fewer), are made distinct first, in the tasks that
    read them, and normal forms once for each after that.
    """
    sound = docs.where(F.col("error").isNull() & ~F.col("ocr") & F.col("kind").isin("SI", "BL"))
    sound = sound if key is None else dealt(sound, key)
    raw = []
    for name in (*K.PARTIES, *K.PORTS):
        field, party = F.col("fields")[name], name in K.PARTIES
        text = stripped(split_behalf(first_line(field), F.lit(""))[0]) if party else field["raw"]
        raw.append(F.struct(F.lit("name" if party else "place").alias("kind"), F.when(~field["blank"], text).alias("raw")))
    each = sound.select(F.explode(F.array(*raw)).alias("e")).select("e.*").where("raw <> ''")
    # Counted, as Spark leaves out a distinct below another one and would make normal forms of every row.
    each = each.groupBy("kind", "raw").agg(F.count("*").alias("n")).where("n > 0")
    entry = F.when(F.col("kind") == "name", canon_name(F.col("raw"))).otherwise(canon_port(F.col("raw"))["place"])
    return once(each, "entry", entry).where("entry <> ''").select("kind", "entry").distinct()


def snap_names(values: DataFrame, names: DataFrame) -> DataFrame:
    """``value, entry`` where the best name is alike enough and clearly ahead of the next."""
    pairs = likely_pairs(values.distinct(), names, K.SNAP_NAME - K.SNAP_LEAD)
    best = Window.partitionBy("value").orderBy(F.desc("score"), F.desc("entry"))
    ranked = pairs.withColumn("n", F.row_number().over(best)).withColumn("next", F.lead("score").over(best)).where("n = 1")
    lead = F.col("score") - F.coalesce("next", F.lit(float(K.SNAP_NAME - K.SNAP_LEAD)))
    clear = F.col("next").isNull() | (lead >= K.SNAP_LEAD)
    return ranked.where((F.col("score") >= K.SNAP_NAME) & clear).select("value", "entry")


def snap_places(values: DataFrame, places: DataFrame) -> DataFrame:
    """``value, entry``: the longest place that the value equals, or begins with; else the most alike one."""
    values = values.distinct()
    short = squash(F.col("entry"))
    keyed = places.select("entry", short.alias("key"))
    text = squash(F.col("value"))
    heads = values.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda n: F.substring(text, F.lit(1), n))).alias("key"), text.alias("text"))
    exact = heads.join(keyed, "key").where((F.col("key") == F.col("text")) | (F.length("key") >= K.SNAP_PREFIX))
    exact = exact.select("value", "entry", F.lit(2).alias("tier"), F.length("entry").cast("double").alias("score"))
    alike = likely_pairs(values, places, K.SNAP_PLACE).select("value", "entry", F.lit(1).alias("tier"), "score")
    best = Window.partitionBy("value").orderBy(F.desc("tier"), F.desc("score"), F.when(F.col("tier") == 2, F.col("entry")).asc_nulls_last(), F.desc("entry"))
    return exact.union(alike).withColumn("n", F.row_number().over(best)).where("n = 1").select("value", "entry")


def scanned_values(docs: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """``email_id, kind (name or place), value``: normal texts of whatever scanned documents were read as, in every pass.

    ``docs`` as extracted; what people entered for a scanned document (``resolutions``) is snapped too, so it is among them.
    """
    scans = docs.where("ocr and kind in ('SI', 'BL')")
    read = scans.select("email_id", F.explode(F.concat(F.array("fields"), F.coalesce("pass_fields", F.array().cast(docs.schema["pass_fields"].dataType)))).alias("m"))
    fields = {n: F.col("m")[n] for n in (*K.PARTIES, *K.PORTS)}
    rows = _texts_of(read, fields)
    if resolutions is None:
        return rows
    side = F.when(F.col("kind") == "SI", F.col("corrections")["si"]).otherwise(F.col("corrections")["bl"])
    entered = scans.select("email_id", "kind").join(resolutions.select("email_id", "corrections"), "email_id").select("email_id", side.alias("m"))
    return rows.union(_texts_of(entered, {n: F.when(f.isNotNull(), correction(f)) for n, f in fields.items()})).distinct()


def _texts_of(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    texts = [F.struct(F.lit("name" if n in K.PARTIES else "place").alias("kind"), normal_value(n, f)["text"].alias("value")) for n, f in fields.items()]
    return rows.select("email_id", F.explode(F.array(*texts)).alias("t")).select("email_id", "t.*").where("value <> ''").distinct()


def snapped(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``email_id, snaps``: per message, maps ``names, places`` from a scanned value to the known entry in its place.

    ``values`` as of :func:`scanned_values`, ``entries`` as of :func:`vocabulary`. Each distinct value is scored once;
    values without an entry clearly theirs aren't in the maps, messages without any have no row.
    """
    of = lambda df, kind, name: df.where(F.col("kind") == kind).select(name)
    names = snap_names(of(values, "name", "value"), of(entries, "name", "entry"))
    places = snap_places(of(values, "place", "value"), of(entries, "place", "entry"))
    found = names.select(F.lit("name").alias("kind"), "value", "entry").union(places.select(F.lit("place").alias("kind"), "value", "entry"))
    pairs = lambda kind: F.map_from_entries(F.collect_set(F.when(F.col("kind") == kind, F.struct("value", "entry"))))
    return values.join(found, ["kind", "value"]).groupBy("email_id").agg(F.struct(pairs("name").alias("names"), pairs("place").alias("places")).alias("snaps"))
