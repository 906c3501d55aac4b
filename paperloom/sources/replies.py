"""JSON out of model replies: thoughts, fences and surrounding words are no obstacle."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salvaged(reply: str | None) -> str | None:
    """The first JSON object of a reply as text, null where there is none.

    In order: the whole, each fenced block, each balanced object from left to right; of a list the first object.
    """
    if not reply:
        return None
    text = re.sub(r"<think>.*?</think>", "", reply, flags=re.S).strip()
    decoder = json.JSONDecoder(parse_constant=lambda _: None)

    def first(value: object) -> str | None:
        if isinstance(value, list):
            value = next((v for v in value if isinstance(v, dict)), None)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    for candidate in [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, flags=re.S)]:
        try:
            if found := first(decoder.decode(candidate.strip())):
                return found
        except ValueError:
            continue
    at = text.find("{")
    while at >= 0:
        try:
            return first(decoder.raw_decode(text, at)[0])
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def _salvage(replies: pd.Series) -> pd.Series:
    return replies.map(salvaged)


def json_of(reply: Column) -> Column:
    """:func:`salvaged` as a column."""
    return _salvage(reply)
