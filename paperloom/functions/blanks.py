"""The ways in which a value counts as blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for nothing.
PLACEHOLDERS = ("", "none", "null", "nan")
EXPORT_PLACEHOLDERS = ("", "None", "null", "nan")
RECOVERY_PLACEHOLDERS = ("", "None", "null")
_SPACE = r"(?U)^\s+|\s+$"


def trimmed(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, _SPACE, "")


def is_blank(text: Column) -> Column:
    """Null, or one of the placeholders in any case; zero isn't blank."""
    return text.isNull() | F.lower(trimmed(text)).isin(*PLACEHOLDERS)


def is_export_blank(text: Column) -> Column:
    """As :func:`is_blank`, but placeholders count only in their own case."""
    return text.isNull() | trimmed(text).isin(*EXPORT_PLACEHOLDERS)


def is_unrecovered(value: Column) -> Column:
    """Null, a placeholder or the number zero: what the recovery may fill."""
    text = value.cast("string")
    return value.isNull() | trimmed(text).isin(*RECOVERY_PLACEHOLDERS) | F.coalesce(text.try_cast("double") == 0, F.lit(False))


def is_white(text: Column) -> Column:
    """Null or white space only."""
    return text.isNull() | (trimmed(text) == "")


def first_present(*values: Column) -> Column:
    """The first value that isn't blank, as text."""
    return F.coalesce(*[F.when(~is_blank(v.cast("string")), v.cast("string")) for v in values])


def first_present_path(**values: Column) -> Column:
    """The name of the first value that isn't blank."""
    return F.coalesce(*[F.when(~is_blank(v.cast("string")), F.lit(n)) for n, v in values.items()])
