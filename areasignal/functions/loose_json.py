"""JSON objects in free text, such as a model's answer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The first object in a text, as JSON; null without one.

    Braces in strings and escaped quotes don't count. An object cut off at the end of the text is closed: an open string
    first, then open lists and objects from the inside; what doesn't parse then is null.
    """
    if not text or (start := text.find("{")) < 0:
        return None
    open_, in_string, escaped, end = [], False, False, None
    for i in range(start, len(text)):
        c = text[i]
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                end = i + 1
                break
    body = text[start:end] if end else text[start:].rstrip().rstrip(",") + ('"' if in_string else "") + "".join(reversed(open_))
    try:
        return json.dumps(json.loads(body), ensure_ascii=False)
    except ValueError:
        return None


def _first_objects(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


def extracted(text: Column) -> Column:
    """The first JSON object in each text: what stands whole from the first to the last brace is checked in the JVM, and
    only the rest goes to Python, to be matched brace by brace."""
    plain = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(F.coalesce(F.try_parse_json(F.nullif(plain, F.lit(""))).isNotNull(), F.lit(False)), plain)
    return F.coalesce(whole, F.pandas_udf(_first_objects, "string")(F.when(whole.isNull(), text)))
