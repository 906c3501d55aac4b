"""Declared checks of single fields, and scores of formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates, identifiers, numbers
from paperloom.functions.blanks import is_white, trimmed
from paperloom.functions.paths import declared


def _share(value: Column) -> Column:
    return numbers.loose_number(F.regexp_replace(trimmed(value), "%$", ""))


def _filled(value: Column, check: Column) -> Column:
    return F.when(is_white(value), False).otherwise(F.coalesce(check, F.lit(False)))


#: Kinds of rules: each says of a text whether it holds. Blank values fail all but optional ones.
KINDS: dict[str, Callable[[Column], Column]] = {
    "not_empty": lambda v: ~is_white(v),
    "required": lambda v: ~is_white(v),
    "date_format": lambda v: _filled(v, dates.flexible_date(v).isNotNull()),
    "valid_date_format": lambda v: _filled(v, dates.flexible_date(v).isNotNull()),
    "positive_number": lambda v: _filled(v, numbers.loose_number(v) > 0),
    "non_negative_number": lambda v: _filled(v, numbers.loose_number(v) >= 0),
    "positive_number_or_percentage": lambda v: _filled(v, _share(v) > 0),
    "valid_percentage": lambda v: _filled(v, _share(v).between(0, 100)),
    "valid_inn": lambda v: _filled(v, identifiers.valid_inn(v)),
    "valid_snils": lambda v: _filled(v, identifiers.valid_snils(v)),
    "valid_ogrn": lambda v: _filled(v, identifiers.valid_ogrn(v)),
    "valid_bik": lambda v: _filled(v, identifiers.valid_bik(v)),
    "ip_number_format": lambda v: _filled(v, identifiers.file_number_score(v) >= 90),
    "ip_number_format_optional": lambda v: is_white(v) | (identifiers.file_number_score(v) >= 90),
}


def guarded(df: DataFrame, rules: list[tuple[str, str]], on_unknown: Callable[[str], None] | None = None) -> DataFrame:
    """``df`` with rules_total, rules_passed, rule_score, ``failed_rules`` and guard_passed for rules (path, kind).

    Kinds that aren't known are reported to ``on_unknown`` and left out of the score; with nothing to check the score
    is 0 and the record doesn't pass.
    """
    cells = []
    for path, kind in rules:
        if kind not in KINDS:
            if on_unknown:
                on_unknown(kind)
            continue
        value = F.col(path).cast("string") if declared(df.schema, path) else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(f"{path}:{kind}").alias("rule"), KINDS[kind](value).alias("ok")))
    held = F.array(*cells) if cells else F.array().cast("array<struct<rule:string,ok:boolean>>")
    out = df.withColumn("_rules", held).withColumn("rules_total", F.size("_rules")).withColumn("rules_passed", F.size(F.filter("_rules", lambda r: r["ok"])))
    score = F.when(F.col("rules_total") > 0, F.bround(F.col("rules_passed") * 100.0 / F.col("rules_total"), 1)).otherwise(0.0)
    out = out.withColumn("rule_score", score).withColumn("failed_rules", F.transform(F.filter("_rules", lambda r: ~r["ok"]), lambda r: r["rule"]))
    return out.withColumn("guard_passed", (F.col("rules_total") > 0) & (F.col("rules_total") == F.col("rules_passed"))).drop("_rules")


def case_number_score(text: Column) -> Column:
    """100 for a well-formed case number, 60 for a long one without separators, 40 for other texts, 0 for none."""
    s = trimmed(text)
    formed = s.rlike(r"(?U)^[А-Яа-я0-9A-Za-z\s№\-–—/.]+$") & (F.length(s) >= 4) & s.rlike("[0-9]")
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(formed & (F.length(s) >= 6) & ~s.rlike("[/–-]"), 60.0).when(formed, 100.0).otherwise(40.0)


def date_score(text: Column) -> Column:
    """100 for a date in digits, 95 for one with a month in words, 20 for other texts, 0 for none."""
    s, low = trimmed(text), F.lower(trimmed(text))
    months = "|".join(ns.split()[0][:-1] for m, ns in dates.MONTHS.items() if m != 5)
    word = low.rlike(rf"(?:{months})") | low.rlike(r"(?U)(?<!\w)ма(?:я|е|й|ю)?\b")
    digits = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)") | s.rlike(r"(?<!\d)\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}(?!\d)")
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(digits, 100.0).when(word, 95.0).otherwise(20.0)


def inn_in_text_score(text: Column) -> Column:
    """100 where one of the text's ten- or twelve-digit numbers is a valid INN, 0 where none is, 50 without such numbers."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{12}|\d{10})(?!\d)"), F.lit(1))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.size(found) == 0, 50.0).when(F.exists(found, identifiers.valid_inn), 100.0).otherwise(0.0)


def balance_score(total: Column, *parts: Column) -> Column:
    """How well parts add up to a total: 100 within 0.05, 90 within 1, else in proportion; 95 without parts, 90 without a total."""
    any_part = F.lit(False)
    for p in parts:
        any_part = any_part | p.isNotNull()
    summed = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    off, has = F.abs(summed - total), F.coalesce(total > 0, F.lit(False))
    near = F.when(off <= 0.05, 100.0).when(off <= 1.0, 90.0).otherwise(F.bround(F.greatest(F.lit(0.0), 1 - off / F.greatest(total, F.lit(1.0))) * 100, 2))
    return F.when(~has & ~any_part, 100.0).when(has & ~any_part, 95.0).when(has, near).otherwise(90.0)
