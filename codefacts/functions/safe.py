"""Bounded, redacted text of nested values (SF20); values come as JSON, so a Pandas UDF reads whole batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.functions.patterns import REDACTED, SENSITIVE
from codefacts.session import ship

DEPTH, ITEMS, CHARS, NESTED = 4, 10, 240, 80


def cut_text(text: str, limit: int) -> str:
    return text if len(text) <= limit else f"{text[:limit]}...(+{len(text) - limit} chars)"


def bounded(value, depth: int = DEPTH, limit: int = CHARS) -> str:
    """Text of a value: so deep, so many items, so many characters; values of sensitive names hidden."""
    if isinstance(value, (dict, list)) and depth <= 0:
        return "{...}" if isinstance(value, dict) else "[...]"
    inner = lambda x: bounded(x, depth - 1, NESTED)
    if isinstance(value, dict):
        parts = [f"{k!r}: {REDACTED if any(p in k.lower() for p in SENSITIVE) else inner(v)}" for k, v in list(value.items())[:ITEMS]]
        return cut_text("{" + ", ".join(parts + [f"...(+{len(value) - ITEMS})"] * (len(value) > ITEMS)) + "}", limit * DEPTH)
    if isinstance(value, list):
        parts = [inner(v) for v in value[:ITEMS]]
        return cut_text("[" + ", ".join(parts + [f"...(+{len(value) - ITEMS})"] * (len(value) > ITEMS)) + "]", limit * DEPTH)
    return cut_text(repr(value), limit)


@F.pandas_udf(T.StringType())
def safe_repr(values: pd.Series) -> pd.Series:
    """Bounded text of JSON values; a text that is no JSON stands for itself, null stays null."""

    def one(text):
        if text is None:
            return None
        try:
            return bounded(json.loads(text))
        except ValueError:
            return cut_text(text, CHARS)

    return values.map(one)


ship(__name__)
