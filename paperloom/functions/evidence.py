"""Whether a value stands in a text: requisites, inflected words, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.blanks import trimmed
from paperloom.functions.numbers import let

# What may separate the characters of a requisite, and what its edges may not touch.
SEPARATORS = r"""[\s\-_.,;:/\\'"«»()№]*"""
BEFORE, AFTER = r"(?<![0-9A-Za-zА-Яа-яЁё])", r"(?![0-9A-Za-zА-Яа-яЁё])"
NUMBER = r"\d{1,3}(?:[ \u00a0]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
#: Texts shorter than this are no evidence.
LEAST_TEXT = 20


def search_form(text: Column) -> Column:
    """Lower case, е for ё, single blanks."""
    return trimmed(F.regexp_replace(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))


def _spaced(chars: Column, gap: str) -> Column:
    return F.array_join(F.transform(chars, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), gap)


def presence_pattern(value: Column) -> Column:
    """A pattern of the value in :func:`search_form`: separators within, endings of words, one stray character.

    Words of five letters or more may take up to three letters; soft endings and final vowels change first.
    """

    def pattern(stem: Column) -> Column:
        chars = F.filter(F.split(stem, ""), lambda c: c != "")
        n = F.length(stem)

        def cut(k: int, ending: str) -> Column:
            return F.concat(_spaced(F.slice(chars, 1, F.greatest(n - k, F.lit(1))), SEPARATORS), F.lit(ending))

        ways = F.array(
            cut(0, ""),
            F.when(n >= 5, cut(0, "[а-яё]{0,3}")),
            F.when((n >= 7) & stem.rlike("(?:ий|ый|ой)$"), cut(2, "[а-яё]{1,4}")),
            F.when((n >= 6) & stem.rlike("[ая]$"), cut(1, "[а-яё]{1,3}")),
            F.when(n >= 6, _spaced(chars, ".?")),
        )
        return F.concat(F.lit(f"{BEFORE}(?:"), F.array_join(F.filter(ways, lambda w: w.isNotNull()), "|"), F.lit(f"){AFTER}"))

    return let(F.regexp_replace(search_form(value), r"(?U)\s", ""), pattern)


def as_amount(text: Column) -> Column:
    """The number that a value is, to the kopeck; null for texts and beyond thirteen digits."""
    n = F.translate(F.regexp_replace(text, r"(?U)\s", ""), ",", ".").try_cast("double")
    return F.when(F.abs(n) < 1e13, F.bround(n, 2))


def numbers_in(text: Column) -> Column:
    """The numbers of a text as they are written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def present(value: Column, text: Column, least: int = 3) -> Column:
    """Whether ``value`` stands in ``text``. Blank and short values need no evidence.

    Values with letters are matched by pattern; numbers by pattern or as equal amounts; digits that are no amount
    (accounts) among the text's digits.
    """
    v = trimmed(value)
    found = F.rlike(search_form(text), presence_pattern(v))
    amount = as_amount(v)
    equal = F.exists(numbers_in(text), lambda z: as_amount(z) == amount)
    digits = F.regexp_replace(v, r"\D", "")
    among = F.exists(numbers_in(text), lambda z: F.regexp_replace(z, r"\D", "") == digits)
    return F.coalesce(
        F.when(v.isNull() | (F.length(v) < least), True)
        .when(v.rlike(r"[^\W\d_]") | v.rlike(r"[а-яёА-ЯЁ]"), found)
        .when(digits == "", True)
        .when(v.rlike(r"[\s\-_.,;:/\\]"), found | equal | (amount.isNull() & among))
        .otherwise(equal | (amount.isNull() & among)),
        F.lit(False),
    )


def gate(text: Column, **fields: Column) -> Column:
    """Names of the fields that the text doesn't bear out; null where the text is too short to tell."""
    missing = F.filter(F.array(*[F.when(~present(v, text), F.lit(n)) for n, v in fields.items()]), lambda x: x.isNotNull())
    return F.when(F.length(trimmed(text)) >= LEAST_TEXT, missing)


def _tokens(text: Column) -> Column:
    """The words of four letters and more."""
    return F.filter(F.split(text, r"[\s,]+"), lambda t: F.length(t) >= 4)


def gate_report(text: Column, fields: dict[str, tuple[Column, int]], names: dict[str, Column] | None = None, authorities: dict[str, Column] | None = None) -> Column:
    """(field, value) of what ``text`` doesn't bear out; null where the text is too short to tell.

    ``fields`` {name: (value, least length)} are looked up whole, but for zeros and values that are too short; ``names`` by
    their first word of four letters; ``authorities`` fail only if none of their words is found. Of equal values
    among fields and names the first one counts.
    """
    def missing(name: str, shown: Column, sought: Column, lacks: Column) -> Column:
        return F.when(lacks, F.struct(F.lit(name).alias("field"), shown.alias("value"), sought.alias("sought")))

    found = []
    for name, (value, least) in fields.items():
        v = trimmed(value.cast("string"))
        nothing = v.isNull() | (F.length(v) < least) | F.coalesce(v.try_cast("double") == 0, F.lit(False)) & v.rlike(r"^[-+]?0*[.,]?0*(?:[eE][-+]?\d+)?$")
        found.append(missing(name, v, v, ~nothing & ~present(v, text, 1)))
    for name, value in (names or {}).items():
        first = F.try_element_at(_tokens(value), F.lit(1))
        found.append(missing(name, value, first, first.isNotNull() & ~present(first, text, 1)))
    once = let(F.filter(F.array(*found), lambda x: x.isNotNull()), lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["sought"] == x["sought"])))
    of = [missing(name, v, v, (F.size(_tokens(v)) > 0) & ~F.exists(_tokens(v), lambda t: present(t, text, 1))) for name, v in (authorities or {}).items()]
    whole = F.concat(once, F.filter(F.array(*of), lambda x: x.isNotNull())) if of else once
    return F.when(F.length(trimmed(text)) >= LEAST_TEXT, F.transform(whole, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"))))
