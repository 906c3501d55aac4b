"""Normalising, masking and reading of texts by pattern."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.blanks import trimmed
from paperloom.session import ship_active

# Letters folded for comparison, each to the one below it.
FOLD_FROM, FOLD_TO = "«»—–авекмнорстх", "\"\"--abekmhopctx"
# Characters that a file name may not hold, and names that it may not be.
RESERVED = ("con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)))


def comparable(text: Column) -> Column:
    """Lower case, single blanks, plain quotes and dashes, letters that look alike folded; null gives an empty text."""
    s = F.regexp_replace(trimmed(F.lower(text)), r"(?U)\s+", " ")
    return F.coalesce(F.translate(F.replace(s, F.lit("№"), F.lit("no")), FOLD_FROM, FOLD_TO), F.lit(""))


def exact_score(pred: Column, truth: Column) -> Column:
    """100 where both texts compare equal (also both empty), else 0."""
    return F.when(comparable(pred) == comparable(truth), 100.0).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        out.append(100.0 if x == y else 0.0 if not x or not y else round(difflib.SequenceMatcher(None, x, y).ratio() * 100, 2))
    return pd.Series(out, dtype="float64")


def similarity_score(pred: Column, truth: Column) -> Column:
    """Ratio of matching blocks, 0 to 100. The one scalar without a native equal: an Arrow function."""
    ship_active()
    return _ratio(comparable(pred), comparable(truth))


def score_status(score: Column) -> Column:
    return F.when(score >= 95, "excellent").when(score >= 85, "high").when(score >= 70, "satisfactory").otherwise("needs_attention")


def file_stem(name: Column) -> Column:
    """A name fit for a file: forbidden characters as underscores, 60 characters at most, no reserved name."""
    s = F.regexp_replace(trimmed(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")), r"[. ]+$", "")
    cut = F.substring(s, 1, 60)
    return F.when(F.coalesce(cut, F.lit("")) == "", "unnamed").when(F.lower(cut).isin(*RESERVED), F.concat(F.lit("_"), cut)).otherwise(cut)


def title_of(path: Column) -> Column:
    """A readable title from a file's name."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.initcap(trimmed(F.regexp_replace(base, r"[_\-\s]+", " ")))


#: What a masked part leaves behind.
MASK = "***REDACTED***"
# What comes before a secret and stays, and the least letters of it that are shown.
SECRETS = ((r"sk-", r"[\w\-]", 8), (r"Bearer\s+", r"[\w.\-]", 8), (r"key[=:]\s*['\"]?", r"[\w\-]", 0))


def masked(text: Column) -> Column:
    """``text`` with keys, bearer tokens and passport numbers masked; their first letters, names and series stay.

    Of a passport only the number after the blank is masked, so other ten digits (an INN) are left alone.
    """
    for lead, letter, shown in SECRETS:
        least = 1 if shown else 7  # a short value after key= may be anything
        text = F.regexp_replace(text, f"({lead}{letter}{{{shown}}}){letter}{{{least},}}", f"$1{MASK}")
    return F.regexp_replace(text, r"(?<!\w)(\d{4}\s+)\d{6}(?!\w)", f"$1{MASK}")


def bounded(word: str) -> str:
    """A pattern for ``word`` with no letter or digit beside it."""
    return rf"(?<![а-яёa-z0-9])\Q{word.lower()}\E(?![а-яёa-z0-9])"


def glob_pattern(glob: str) -> str:
    """The pattern of parts in their order; a single short part must be a whole word."""
    parts = [p.lower() for p in glob.split("*") if p]
    if len(parts) == 1 and len(parts[0]) <= 4:
        return bounded(parts[0])
    return ".*".join(rf"\Q{p}\E" for p in parts)


def listed(values: Column) -> Column:
    """An array as text, joined by commas; null gives an empty text."""
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Да").when(~flag, "Нет").otherwise("")


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


@dataclass(frozen=True)
class Labelled:
    """Digits known by a label before them, or else by how they begin."""

    labels: tuple[str, ...]
    least: int
    most: int
    starts: tuple[str, ...] = ()
    bare: bool = False  # so many digits alone will do

    def read(self, text: Column) -> Column:
        size = str(self.least) if self.least == self.most else f"{self.least},{self.most}"
        names = "|".join(r"\s*".join(rf"\Q{w}\E" for w in label.split()) for label in sorted(self.labels, key=len, reverse=True))
        ways = [rf"(?iuU)(?:{names})[\s:№]*(\d{{{size}}})(?!\w)"]
        ways += [rf"(?U)(?<!\w)(?={start})(\d{{{size}}})(?!\w)" for start in self.starts]
        return _first(text, *ways, *([rf"(?U)(?<!\w)(\d{{{size}}})(?!\w)"] if self.bare else []))


# Labels of bank details, how many digits they have, and how those begin.
DETAILS = {
    "bik": Labelled(("БИК", "БИК ТОФК"), 9, 9, ("0[1-4]",)),
    "account": Labelled(("казначейский счет", "расчетный счет", "р/с", "счет", "сч"), 20, 20, ("03[12]|401",), True),
    "inn": Labelled(("ИНН", "ИНН получателя"), 10, 10),
    "kpp": Labelled(("КПП", "КПП получателя"), 9, 9),
    "oktmo": Labelled(("ОКТМО",), 8, 11),
    "uin": Labelled(("УИН",), 20, 25, ("322",)),
}


def payment_details(text: Column) -> dict[str, Column]:
    """Bank details named in running text: bik, account, inn, kpp, oktmo and uin; null where there is none."""
    return {name: labelled.read(text) for name, labelled in DETAILS.items()}


# Words before a document's date and number.
DATED, NUMBERED = ("от", "дата", "выдан"), ("№", "номер", "N")


def base_document(text: Column) -> dict[str, Column]:
    """Number and date of the document that a text names; empty where there is none. A number may stand in brackets."""
    day, sign = r"\d{1,2}[./-]\d{1,2}[./-]\d{4}", r"[\w./-]"
    date = _first(text, rf"(?iuU)(?:{'|'.join(DATED)})[\s:]*({day})", rf"(?U)(?<!\w)({day})(?!\w)")
    number = _first(text, rf"(?iuU)(?:{'|'.join(NUMBERED)})[\s:]*({sign}*[\w/-])", rf"(?U)\(({sign}+)\)")
    return {"number": F.coalesce(number, F.lit("")), "date": F.coalesce(date, F.lit(""))}


# Words before an office's code in running text.
OFFICE_LABELS = ("ВКСП", "код", "РОСП")


def office_code(file_number: Column, explicit: Column | None = None, *texts: Column) -> Column:
    """Five digits of the office: as given, else the last part of a case file's number, else after a label in ``texts``.

    What was given stays where nothing is found; without it the result is an empty text.
    """
    given = trimmed(explicit) if explicit is not None else F.lit(None).cast("string")
    named = [_first(t, rf"(?iuU)(?:{'|'.join(OFFICE_LABELS)})[\s:]+(\d{{5}})(?!\w)") for t in texts]
    stated = _first(file_number, r"(?iu)/(\d{5})-ИП", r"(?iuU)(?<!\w)(\d{5})-ИП(?!\w)")
    return F.coalesce(F.when(given.rlike(r"^\d{5}$"), given), stated, *named, explicit if explicit is not None else F.lit(""), F.lit(""))


# Bank details within a claim's requisites, by their labels.
REQUISITES = {"payment_account": (r"р/сч?|расч\.?\s*сч[её]т|расч[её]тный\s+сч[её]т", 20), "bik": ("БИК", 9), "kpp": ("КПП", 9)}


def requisites(text: Column) -> Column:
    """A struct of payment_account, bik, kpp and bank_name of requisites written as one text; what is missing is null."""
    parts = [_first(text, rf"(?iuU)(?:{label})\D{{0,10}}(\d{{{n}}})").alias(name) for name, (label, n) in REQUISITES.items()]
    bank = trimmed(_first(text, r"(?U)((?:ПАО|АО|ЗАО|ОАО|[Бб]анк)\s+[А-ЯЁA-Za-z«»\s-]+)"))
    return F.when(text.isNotNull(), F.struct(*parts, bank.alias("bank_name")))
