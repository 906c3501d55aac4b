"""Dates in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.blanks import trimmed
from paperloom.functions.numbers import let

# Month names, nominative and genitive, by number.
MONTHS = {1: "январь января", 2: "февраль февраля", 3: "март марта", 4: "апрель апреля", 5: "май мая", 6: "июнь июня", 7: "июль июля", 8: "август августа", 9: "сентябрь сентября", 10: "октябрь октября", 11: "ноябрь ноября", 12: "декабрь декабря"}


def _built(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (year != "0000"), F.try_to_date(text, "yyyy-MM-dd"))


def flexible_date(text: Column) -> Column:
    """The date in ``text``: ISO, d.m.y, d/m/y (not within longer numbers) or with the month in words; null if none is valid."""
    iso, dots, slashes = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b", r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", r"(?U)(?<![\w/])(\d\d?)/(\d\d?)/(\d{4})(?![/\d])"
    numbered = F.create_map(*[F.lit(x) for m, ns in MONTHS.items() for n in ns.split() for x in (n, str(m))])
    words = rf"(\d{{1,2}})\s+({'|'.join(n for ns in MONTHS.values() for n in ns.split()[::-1])})\s+(\d{{4}})"
    x = F.regexp_extract

    def read(s: Column) -> Column:
        ways = [_built(x(s, iso, 1), x(s, iso, 2), x(s, iso, 3)), _built(x(s, dots, 3), x(s, dots, 2), x(s, dots, 1)), _built(x(s, slashes, 3), x(s, slashes, 2), x(s, slashes, 1))]
        return F.when(s.rlike(r"\d"), F.coalesce(*ways, _built(x(s, words, 3), F.try_element_at(numbered, x(s, words, 2)), x(s, words, 1))))

    return let(F.lower(trimmed(text)), read)


def iso_text(text: Column) -> Column:
    """``text`` as yyyy-mm-dd where it holds a date's digits, day first before year first; not checked against the calendar."""
    s = trimmed(text)
    first, last = r"(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})", r"(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})"

    def put(p: str, y: int, d: int) -> Column:
        return F.concat_ws("-", F.regexp_extract(s, p, y), F.lpad(F.regexp_extract(s, p, 2), 2, "0"), F.lpad(F.regexp_extract(s, p, d), 2, "0"))

    return F.when(F.coalesce(s, F.lit("")) == "", "").when(s.rlike(first), put(first, 3, 1)).when(s.rlike(last), put(last, 1, 3)).otherwise(s)


def in_order(before: Column, after: Column) -> Column:
    """``ok``, ``inverted`` or ``incomplete`` for two parsed dates."""
    return F.when(before.isNull() | after.isNull(), "incomplete").when(after < before, "inverted").otherwise("ok")
