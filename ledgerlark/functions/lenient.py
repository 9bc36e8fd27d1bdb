"""JSON objects out of text that says more than the object."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```(?:json)?|```$", re.M)


def object_in(text: str | None) -> dict | None:
    """The JSON object in a text: from the first brace to the last if that is one, else the first whole one.

    Braces within strings, escapes and code fences don't mislead it: where an object ends is what a JSON decoder says.
    """
    if not text:
        return None
    decoder, first, last = json.JSONDecoder(), text.find("{"), text.rfind("}")
    if first < 0 or last < first:
        return None
    try:
        return json.loads(text[first : last + 1])
    except ValueError:
        pass
    for plain in (text, _FENCE.sub("", text)):
        at = plain.find("{")
        while at >= 0:
            try:
                return decoder.raw_decode(plain, at)[0]
            except ValueError:
                at = plain.find("{", at + 1)
    return None


def _objects(texts: pd.Series) -> pd.Series:
    found = [object_in(t) for t in texts]
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)


def json_object(c: Column) -> Column:
    """The object of each text as JSON for :func:`pyspark.sql.functions.from_json`; null where there is none."""
    return F.pandas_udf(_objects, "string")(c)
