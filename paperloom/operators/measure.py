"""How often the gate doubts true values when the text it looks them up in was misread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators import audit
from paperloom.session import ship_active

# Characters that are misread, and what they are read as.
MISREAD = {
    "0": "Оо", "1": "Іі", "2": "Zz", "3": "Зз", "4": "Чч", "5": "Бб", "6": "Ьь", "7": "Тт", "8": "Вв", "9": "Gg", "р": "р", "к": "к", "о": "о",
    "а": "а", "е": "е", "с": "с", "х": "х", "у": "у", "и": "и", "н": "п", "м": "ш", "д": "л", "г": "т", "ш": "щ", "ь": "ъ",
}
# Of changed characters, the shares that are misread (where they can be), and lost or misread; the rest is doubled.
READ_WRONG, OR_LOST = 0.55, 0.8
REVIEWED = ("discrepancy", "gate_not_executed", "heuristic")


def misread(text: str, rate: float, seed: int) -> str:
    """``text`` with about ``rate`` of its letters and digits misread, lost or doubled; the same for the same seed."""
    if not text or rate <= 0:
        return text
    draw = np.random.default_rng(seed).random((3, len(text)))

    def change(i: int, c: str) -> str:
        if not c.isalnum() or draw[0, i] >= rate:
            return c
        ways = MISREAD.get(c.lower(), "")
        if ways and draw[1, i] < READ_WRONG:
            return ways[int(draw[2, i] * len(ways))]
        return "" if draw[1, i] < OR_LOST else c + c

    return "".join(change(i, c) for i, c in enumerate(text))


@F.pandas_udf(T.StringType())
def _misread(texts: pd.Series, rates: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else misread(t, r, s & 0x7FFFFFFF) for t, r, s in zip(texts, rates, seeds, strict=True)], dtype=object)


def noisy(text: Column, rate: Column, *seed: Column) -> Column:
    """Column form of :func:`misread`, seeded by a hash of ``seed``."""
    ship_active()
    return _misread(text, rate.cast("double"), F.xxhash64(*seed))


def gate_curve(records: DataFrame, spec: audit.Spec, text: Column, key: str, rates: list[float], repeats: int = 1) -> DataFrame:
    """For each rate: checks made, those that end as a discrepancy in percent, and those that a person must look at.

    Each record's ``text`` is misread ``repeats`` times at each rate; one pass, only the counts are shuffled.
    """
    runs = records.withColumn("_text", text).withColumn("_rate", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).withColumn("_run", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    read = runs.withColumn("_text", noisy(F.col("_text"), F.col("_rate"), F.col(key), F.col("_rate"), F.col("_run")))
    done = audit.audited(read, spec, raw_text=F.col("_text"), gate_expected=F.lit(True))
    percent = lambda c: F.bround(F.avg(c.cast("int")) * 100, 1)
    return done.groupBy(F.col("_rate").alias("rate")).agg(F.count(F.lit(1)).alias("checks"), percent(F.col("verdict") == "discrepancy").alias("false_positive_percent"), percent(F.col("verdict").isin(*REVIEWED)).alias("review_percent"))
