"""Check digits and formats of Russian identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.blanks import trimmed
from paperloom.functions.numbers import let

# Weights of the check digits.
INN10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN12A = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN12B = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
ACCOUNT = [7, 1, 3] * 7 + [7, 1]
#: The largest SNILS number that has no check digits.
SNILS_EXEMPT = 1_001_998


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _at(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def _weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _at(d, i) * w
    return total


def valid_inn(text: Column) -> Column:
    """Ten or twelve digits whose last (two) agree with the others; null and other lengths are not valid."""

    def check(d: Column) -> Column:
        ten = _weighted(d, INN10) % 11 % 10 == _at(d, 9)
        twelve = (_weighted(d, INN12A) % 11 % 10 == _at(d, 10)) & (_weighted(d, INN12B) % 11 % 10 == _at(d, 11))
        return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve)

    return F.coalesce(let(digits(text), check), F.lit(False))


def valid_snils(text: Column) -> Column:
    """Eleven digits; numbers up to ``SNILS_EXEMPT`` have no check digits."""

    def rest(total: Column) -> Column:
        return F.when(total < 100, total).when(total.isin(100, 101), 0).otherwise(F.when((total % 101).isin(100, 101), 0).otherwise(total % 101))

    def check(d: Column) -> Column:
        key = let(_weighted(d, list(range(9, 0, -1))), rest)
        return (F.length(d) == 11) & ((F.substring(d, 1, 9).cast("int") <= SNILS_EXEMPT) | (key == F.substring(d, 10, 2).cast("int")))

    return F.coalesce(let(digits(text), check), F.lit(False))


def valid_ogrn(text: Column) -> Column:
    """Thirteen digits (remainder by 11) or fifteen (by 13)."""

    def rest(d: Column, n: int, by: int) -> Column:
        return F.substring(d, 1, n).try_cast("bigint") % by % 10 == _at(d, n)

    return F.coalesce(let(digits(text), lambda d: F.when(F.length(d) == 13, rest(d, 12, 11)).when(F.length(d) == 15, rest(d, 14, 13))), F.lit(False))


def valid_bik(text: Column) -> Column:
    """Nine digits that begin with 04 or 01."""
    d = digits(text)
    return F.coalesce((F.length(d) == 9) & F.substring(d, 1, 2).isin("04", "01"), F.lit(False))


def valid_account(account: Column, bik: Column) -> Column:
    """Twenty digits whose key agrees with the bank's code."""

    def check(v: Column) -> Column:
        head = F.when(F.startswith(v["a"], F.lit("30101")), F.concat(F.lit("0"), F.substring(v["b"], 5, 2))).otherwise(F.substring(v["b"], 7, 3))
        key = let(F.concat(head, v["a"]), lambda d: _weighted(d, ACCOUNT) % 10)
        return (F.length(v["a"]) == 20) & (F.length(v["b"]) == 9) & (key == 0)

    return F.coalesce(let(F.struct(digits(account).alias("a"), digits(bik).alias("b")), check), F.lit(False))


def valid_kpp(text: Column) -> Column:
    return F.coalesce(F.length(digits(text)) == 9, F.lit(False))


def case_file_number(text: Column) -> Column:
    """Numbers of enforcement cases written without strokes, with them put in; a number sign before them is dropped.

    Anything else, and what has a stroke already, stays but for white space at its ends.
    """
    s = trimmed(text)
    return F.when(F.contains(s, F.lit("/")), s).otherwise(F.regexp_replace(s, r"(?U)^№*\s*(\d{5})(\d{2})(\d{4,6})-ИП$", "$1/$2/$3-ИП"))


def file_number_score(text: Column) -> Column:
    """100 for a stroke and a digit, 80 for four characters with a digit, else 30."""
    digit = text.rlike(r"\d")
    return F.when(digit & F.contains(text, F.lit("/")), 100.0).when(digit & (F.length(text) >= 4), 80.0).otherwise(30.0)


# What stands for a kind of document that wasn't read, as words.
NO_KIND = """unknown; undefined; null; none; nan; n a; n d; nd; н а; н д; не определен; неопределен; неопределенный; неопределенный документ;
не определен документ; неопределенный тип документа; не определен тип документа; неизвестно; неизвестный; неизвестный документ;
неизвестный тип документа; не удалось определить; нет; нет данных; нет значения; нет типа; отсутствует; отсутствует значение; не указан;
не указано; не заполнено; не распознан; не распознано; тип документа; вид документа; doc type; document type"""


def no_kind(text: Column) -> Column:
    """Whether a kind of document is null, empty or a placeholder, whatever its case, signs and blanks."""
    plain = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    words = F.trim(F.regexp_replace(plain, "[^0-9a-zа-я]+", " "))
    return F.coalesce(words.isin("", *[" ".join(x.split()) for x in NO_KIND.split(";")]), F.lit(True))


# Forms of fields that have no check digits.
FORMS = {"blank_series": "^[А-ЯЁA-Z]{1,6}$", "blank_number": r"^\d{6,12}$", "kpp": r"^\d{9}$", "oktmo": r"^(?:\d{8}|\d{11})$", "bik": r"^0[14]\d{7}$", "account": r"^\d{20}$"}


def well_formed(text: Column, kind: str) -> Column:
    """Whether ``text`` has the form of a ``kind`` of ``FORMS``, digits alone being compared where it consists of them; null for blanks."""
    value = digits(text) if r"\d" in FORMS[kind] and kind != "blank_number" else F.upper(trimmed(text))
    return F.when(F.coalesce(trimmed(text), F.lit("")) != "", value.rlike(FORMS[kind]))


def bank_state(bik: Column, account: Column) -> Column:
    """What is wrong with a bank's code and an account: ``bik``, ``account``, ``key`` or ``ok``; null where both are blank."""
    b, a = (F.nullif(digits(x), F.lit("")) for x in (bik, account))
    return (
        F.when(b.isNull() & a.isNull(), None)
        .when(b.isNotNull() & ~well_formed(b, "bik"), "bik")
        .when(a.isNotNull() & ~well_formed(a, "account"), "account")
        .when(a.isNotNull() & b.isNotNull() & ~valid_account(a, b), "key")
        .otherwise("ok")
    )
