"""Flat rows for import: one select made from a declaration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dates, numbers, text
from paperloom.functions.blanks import is_export_blank, trimmed
from paperloom.functions.paths import declared


def flat(df: DataFrame, keep: list[str], columns: dict[str, tuple[str, str]], constants: dict[str, Column] | None = None) -> DataFrame:
    """Columns ``keep``, then each of ``columns`` {name: (kind, paths)}: the first value that isn't blank, cast by kind.

    Kinds are text (empty where there is none), number (0 where there is none) and date (ISO text). Paths are joined
    by bars; those that the records lack count as blank.
    """
    cells = []
    for name, (kind, path) in columns.items():
        ways = [F.col(p).cast("string") for p in path.split("|") if declared(df.schema, p)]
        value = F.coalesce(*[F.when(~is_export_blank(w), trimmed(w)) for w in ways]) if ways else F.lit(None).cast("string")
        if kind == "number":
            cell = F.coalesce(numbers.loose_number(value), F.lit(0.0))
        elif kind == "date":
            cell = F.coalesce(dates.iso_text(value), F.lit(""))
        else:
            cell = F.coalesce(value, F.lit(""))
        cells.append(cell.alias(name))
    return df.select(*keep, *cells, *[c.alias(n) for n, c in (constants or {}).items()])


def with_verdict(df: DataFrame, verdict: Column, review: Column, advisory: list[str]) -> DataFrame:
    """``df`` with the columns that carry an audit's outcome; without one, the record counts as unchecked and for review."""
    checked = verdict.isNotNull() & (verdict != "")
    return df.withColumns({"Verdict": F.coalesce(verdict, F.lit("")), "VerdictValid": F.when(checked, verdict != "discrepancy"), "RequiresHumanReview": review | ~checked, "AdvisoryReview": F.coalesce(verdict.isin(*advisory), F.lit(False))})


def unwrapped(df: DataFrame, data: str, carried: list[str]) -> DataFrame:
    """The fields of a record's payload, and of ``carried`` those that the payload lacks."""
    own = df.schema[data].dataType.names
    return df.select(f"{data}.*", *[c for c in carried if c not in own])


def status_of(df: DataFrame) -> Column:
    """The verdict that a record carries, in whatever form: in its own column, in a flat row's, or within a report; else empty."""
    paths = ("zero_trust_status", "ZeroTrustStatus", "zero_trust.status", "ZeroTrustReport.status")
    return F.coalesce(*[F.nullif(F.col(p).cast("string"), F.lit("")) for p in paths if declared(df.schema, p)], F.lit(""))


# The fields of deductions whose texts may name bank details, where the record has none of its own.
PAYMENT_TEXTS = ("finances.periodic_details", "claimant_details", "debtor_details", "notes", "authority.address", "claim_subject")
_DETAIL = {"Bik": "bik", "PaymentAccount": "payment_account", "RecipientInn": "recipient_inn", "RecipientKpp": "recipient_kpp", "Oktmo": "oktmo", "Uin": "uin"}
_IN_TEXT = {"payment_account": "account", "recipient_inn": "inn", "recipient_kpp": "kpp"}


def payment_rows(df: DataFrame, keep: list[str], default_db: int = 10) -> DataFrame:
    """Columns ``keep`` and the flat row of a deduction for import, its columns in alphabetical order.

    Bank details come from ``payment_details`` or else from the record's texts; the recipient from there, from a text, or
    from the authority; date and number of the base document from their own fields or from its text. What is missing is an
    empty text. The kinds of payment and recipient are business rules and left out.
    """
    has = lambda p: declared(df.schema, p)
    at = lambda *ps: F.coalesce(*[F.when(~is_export_blank(F.col(p).cast("string")), trimmed(F.col(p).cast("string"))) for p in ps if has(p)], F.lit(None).cast("string"))
    texts = F.concat_ws(" ", *[F.col(p) for p in PAYMENT_TEXTS if has(p)])
    found, base = text.payment_details(texts), text.base_document(at("base_doc"))
    cells = {name: F.coalesce(at(f"payment_details.{own}"), found[_IN_TEXT.get(own, own)]) for name, own in _DETAIL.items()}
    named = F.nullif(trimmed(F.regexp_extract(texts, r"(?iu)(?:получател[ьяе]|в пользу)[\s:]*([^\n;,.]{5,100}\([^)]+\)|УФК[^\n;,]{5,80})", 1)), F.lit(""))
    empty = lambda c: F.nullif(c, F.lit(""))
    cells |= {
        "DbCode": F.coalesce(at("db_code").try_cast("int"), F.lit(default_db)),
        "ExecutiveDocumentDate": dates.iso_text(F.coalesce(at("base_doc_date"), empty(base["date"]))),
        "ExecutiveDocumentNumber": F.coalesce(at("base_doc_number"), empty(base["number"]), at("doc_number", "ip_number")),
        "FSSP_Head": at("authority.name"),
        "OrganizationName": at("employer.name"),
        "PurposeType": F.lit("ExecutiveProduction"),
        "Recipient": F.coalesce(at("payment_details.recipient"), named, F.concat(F.lit("УФК ("), at("authority.name"), F.lit(")"))),
        "ResolutionDate": dates.iso_text(at("doc_date", "act_date")),
        "RospAddressFakt": at("authority.address"),
        "RospBailiffFio": at("authority.officer"),
        "RospFullCode": text.office_code(F.concat_ws(" ", at("ip_number"), at("doc_number")), at("payment_details.rosp_code"), texts),
    }
    return df.select(*keep, *[(c if n == "DbCode" else F.coalesce(c, F.lit(""))).alias(n) for n, c in sorted(cells.items(), key=lambda x: x[0].lower())])


# The flat columns of deductions and claims.
DEDUCTION = {
    "DocNumber": ("text", "doc_number"), "DocDate": ("date", "doc_date"), "IpNumber": ("text", "ip_number"), "Authority": ("text", "authority.name"),
    "Claimant": ("text", "claimant_name"), "Debtor": ("text", "debtor_name"), "Employer": ("text", "employer.name"),
    "Debt": ("number", "finances.debt_amount_rub"), "Fee": ("number", "finances.fee_penalty_rub"), "Total": ("number", "finances.total_deduction_rub|finances.debt_amount_rub"),
}
