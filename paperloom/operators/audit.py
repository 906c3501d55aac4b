"""Rule audit of records: identifiers, sums of amounts, order of dates, and the verdict they give."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import dates, evidence, identifiers, numbers, paths
from paperloom.functions.blanks import first_present, is_blank

CHECKS = {"inn": identifiers.valid_inn, "snils": identifiers.valid_snils, "ogrn": identifiers.valid_ogrn, "bik": identifiers.valid_bik, "kpp": identifiers.valid_kpp}
ISSUE = "struct<severity:string,code:string,field_name:string>"
#: Digits under which an identifier counts as cut.
LEAST_DIGITS = 9


@dataclass
class Spec:
    """Declared rules of one record type. Paths may have alternatives (``a.b|c``)."""

    identifiers: list[dict] = field(default_factory=list)  # path, kind, severity
    money: list[dict] = field(default_factory=list)  # code, total, parts, min_parts, tolerance, severity; the first that applies holds
    chronology: list[dict] = field(default_factory=list)  # before, after, code, severity
    bank: dict[str, str] = field(default_factory=dict)  # bik, account, uin, office, oktmo, kpp: paths
    bank_texts: list[str] = field(default_factory=list)  # paths of requisites written as one text
    bank_names: list[str] = field(default_factory=list)  # paths that may name the Bank of Russia
    doc_refs: list[str] = field(default_factory=list)  # paths of numbers of eight or nine digits
    gate_fields: dict[str, int] = field(default_factory=dict)  # path: least length
    gate_names: list[str] = field(default_factory=list)
    gate_authorities: list[str] = field(default_factory=list)

    def problems(self, schema: T.StructType) -> list[str]:
        """What is wrong with the rules themselves: bounds, severities, kinds and paths that the schema lacks."""
        out = []
        for rule in self.identifiers:
            if rule["kind"] not in CHECKS:
                out.append(f"unknown kind {rule['kind']}")
        for rule in self.money:
            if not 1 <= rule.get("min_parts", 2) <= len(rule["parts"]):
                out.append(f"{rule['code']}: min_parts is out of bounds")
        for rule in [*self.identifiers, *self.money]:
            if rule.get("severity", "error") not in ("error", "warning", "info"):
                out.append(f"unknown severity {rule['severity']}")
        if unknown := set(self.bank) - {"bik", "account", "uin", "office", "oktmo", "kpp"}:
            out.append(f"unknown bank details {sorted(unknown)}")
        named = [r["path"] for r in self.identifiers] + [p for r in self.money for p in (r["total"], *r["parts"])] + [p for r in self.chronology for p in (r["before"], r["after"])]
        out += [f"no such path: {p}" for ps in named for p in ps.split("|") if not paths.declared(schema, p)]
        return out


def _issue(when: Column, severity: str, code: str, path: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(path).alias("field_name")))


# Names of fields that hold a date, alone or after an underscore.
DATE_NAMES = ("date", "date_from", "date_to", "valid_until", "term_start", "term_end", "period_start", "period_end", "signed_date", "deadline_date", "ip_date")
#: Dots an inch under which a scan counts as poor.
LEAST_DPI = 150


def date_leaves(schema: T.StructType, above: str = "") -> list[str]:
    """Paths of the text fields outside arrays whose names are those of dates."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += date_leaves(f.dataType, f"{above}{f.name}.")
        elif isinstance(f.dataType, T.StringType) and any(f.name.lower() == n or f.name.lower().endswith("_" + n) for n in DATE_NAMES):
            out.append(above + f.name)
    return out


def _text(schema: T.StructType, path: str | None) -> Column:
    """The value at ``path``, trimmed; null where it is blank or the schema has no such path."""
    if not path or not paths.declared(schema, path):
        return F.lit(None).cast("string")
    return first_present(*[F.col(p) for p in path.split("|") if paths.declared(schema, p)])


def _bank(schema: T.StructType, spec: Spec) -> tuple[list[tuple[Column, str, str, str]], list[tuple[Column, Column]]]:
    """(issues as (when, severity, code, path), checks as (made, held)) of bank details: code, key of the account, office within the UIN, lengths."""
    bank, issues, checks = spec.bank, [], []
    free = [F.nullif(F.regexp_extract(_text(schema, p), r"(?<!\d)(0[14]\d{7})(?!\d)", 1), F.lit("")) for p in spec.bank_texts]
    bik, account = F.coalesce(_text(schema, bank.get("bik")), *free), _text(schema, bank.get("account"))
    told, ok = F.coalesce(F.length(bik) >= 8, F.lit(False)), identifiers.valid_bik(bik)
    checks.append((told, ok))
    issues.append((told & ~ok, "error", "INVALID_BIK", bank.get("bik", "bik")))
    if "account" in bank:
        both, key = account.isNotNull() & bik.isNotNull(), identifiers.valid_account(account, bik)
        central = F.lower(F.concat_ws(" ", *[_text(schema, p) for p in spec.bank_names])).rlike("банк россии|гркц") if spec.bank_names else F.lit(False)
        checks.append((both, key))
        issues.append((both & ~key & central, "warning", "BANK_ACCOUNT_UNVERIFIED", bank["account"]))
        issues.append((both & ~key & ~central, "error", "INVALID_BANK_ACCOUNT", bank["account"]))
        issues.append((account.isNotNull() & bik.isNull(), "warning", "ACCOUNT_WITHOUT_BIK", bank["account"]))
    if "uin" in bank and "office" in bank:
        uin, office = (F.coalesce(identifiers.digits(_text(schema, bank[k])), F.lit("")) for k in ("uin", "office"))
        made, held = (F.length(uin) >= 20) & (office != ""), F.contains(uin, office)
        checks.append((made, held))
        issues.append((made & ~held, "warning", "UIN_ROSP_MISMATCH", bank["uin"]))
    for name, sizes in (("oktmo", (8, 11)), ("kpp", (9,))):
        n = F.length(identifiers.digits(_text(schema, bank.get(name))))
        issues.append(((n > 0) & ~n.isin(*sizes), "warning", f"INVALID_{name.upper()}", bank.get(name, name)))
    for path in spec.doc_refs:
        n = F.length(identifiers.digits(_text(schema, path)))
        issues.append(((n >= 7) & ~n.isin(8, 9), "warning", "INVALID_DOC_REF_NUMBER", path))
    return issues, checks


def audited(df: DataFrame, spec: Spec, raw_text: Column | None = None, dpi: Column | None = None, recovered: Column | None = None, gate_expected: Column | None = None) -> DataFrame:
    """``df`` with ``issues``, checksums_checked, checksums_ok, money_checked, money_ok and ``verdict``.

    The rules are compiled to columns: one projection, nothing is shuffled. Of the amount rules the first one that
    applies counts: the total is there and so are ``min_parts`` parts; a total or part that is no number is a discrepancy;
    absent parts count as nothing. ``raw_text`` is the document's text that the gate fields are looked up in, ``dpi`` the
    scan's resolution, ``recovered`` whether amounts come from the text by pattern, ``gate_expected`` whether there should be a text.
    """
    schema, issues, checks = df.schema, [], []
    no = F.lit(False)
    for rule in spec.identifiers:
        value = F.col(rule["path"]).cast("string")
        there = ~is_blank(value)
        cut = F.length(identifiers.digits(value)) < LEAST_DIGITS
        ok = CHECKS[rule["kind"]](value)
        checks.append((there & ~cut, ok))
        issues.append((there & cut, "warning", "IDENTIFIER_CUT", rule["path"]))
        issues.append((there & ~cut & ~ok, rule.get("severity", "error"), f"{rule['kind'].upper()}_CHECKSUM", rule["path"]))
    if spec.bank or spec.bank_texts or spec.doc_refs:
        more, made = _bank(schema, spec)
        issues += more
        checks += made
    taken, money_checked, money_ok = no, no, no
    for rule in spec.money:
        texts = [_text(schema, p) for p in (rule["total"], *rule["parts"])]
        total, *parts = map(numbers.loose_number, texts)
        bad_total = texts[0].isNotNull() & total.isNull()
        bad_part = texts[0].isNotNull() & ~bad_total & reduce(Column.__or__, [t.isNotNull() & p.isNull() for t, p in zip(texts[1:], parts, strict=True)])
        filled = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        compared = total.isNotNull() & ~bad_part & (filled >= rule.get("min_parts", 2))
        summed = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        off = F.abs(F.bround(summed, 2) - total) > rule.get("tolerance", 0.05)
        severity = rule.get("severity", "error")
        issues.append((~taken & bad_total, "error", rule["code"], rule["total"]))
        issues.append((~taken & (bad_part | compared & off), severity, rule["code"], rule["total"]))
        money_checked = money_checked | ~taken & (bad_part | compared)
        money_ok = money_ok | F.coalesce(~taken & compared & ~off, no)
        taken = taken | bad_total | bad_part | compared
    for path in date_leaves(schema):
        issues.append((~is_blank(F.col(path)) & dates.flexible_date(F.col(path)).isNull(), "warning", "UNPARSEABLE_DATE", path))
    for rule in spec.chronology:
        before, after = (dates.flexible_date(_text(schema, rule[k])) for k in ("before", "after"))
        issues.append((dates.in_order(before, after) == "inverted", rule.get("severity", "warning"), rule["code"], rule["after"]))
    poor, executed = no, no
    if raw_text is not None:
        of = lambda names: {p: _text(schema, p) for p in names}
        missing = evidence.gate_report(raw_text, {p: (_text(schema, p), n) for p, n in spec.gate_fields.items()}, of(spec.gate_names), of(spec.gate_authorities))
        executed = missing.isNotNull()
        gate = F.transform(missing, lambda x: F.struct(F.lit("error").alias("severity"), F.lit("NOT_IN_TEXT").alias("code"), x["field"].alias("field_name")))
    if gate_expected is not None:
        issues.append((gate_expected & ~executed, "warning", "GATE_NOT_EXECUTED", "gate"))
    if dpi is not None:
        poor = F.coalesce((dpi > 0) & (dpi < LEAST_DPI), no)
        issues.append((poor, "warning", "OCR_LOW_CONFIDENCE", "scan"))
    array = F.filter(F.array(*[_issue(*x) for x in issues]), lambda x: x.isNotNull()) if issues else F.array().cast(f"array<{ISSUE}>")
    # told from its own conditions: a plan that needs the verdict alone looks at no warnings
    error = reduce(Column.__or__, [F.coalesce(when, no) for when, severity, _, _ in issues if severity == "error"], no)
    if raw_text is not None:
        error = error | F.coalesce(F.size(missing) > 0, no)
        array = F.concat(array, F.coalesce(gate, F.array().cast(f"array<{ISSUE}>")))
    made = [F.coalesce(m, no).cast("int") for m, _ in checks]
    held = [F.coalesce(m & h, no).cast("int") for m, h in checks]
    out = df.withColumn("issues", array).withColumn("checksums_checked", sum(made, F.lit(0))).withColumn("checksums_ok", sum(held, F.lit(0)))
    out = out.withColumn("money_checked", F.coalesce(money_checked, no)).withColumn("money_ok", F.coalesce(money_ok, no))
    skipped = gate_expected & ~executed if gate_expected is not None else no
    return out.withColumn("verdict", verdict(poor, recovered if recovered is not None else no, skipped, error))


def verdict(poor: Column | None = None, recovered: Column | None = None, skipped: Column | None = None, error: Column | None = None) -> Column:
    """The ladder: an error is a discrepancy; then a poor scan, recovered amounts, a gate that should have run and didn't;
    checksums and sums that hold are verified; either of them looked at is partial."""
    error, no = F.exists("issues", lambda x: x["severity"] == "error") if error is None else error, F.lit(False)
    return (
        F.when(error, "discrepancy")
        .when(F.coalesce(no if poor is None else poor, no), "low_resolution")
        .when(F.coalesce(no if recovered is None else recovered, no), "heuristic")
        .when(F.coalesce(no if skipped is None else skipped, no), "gate_not_executed")
        .when((F.col("checksums_ok") > 0) & F.col("money_ok"), "verified")
        .when((F.col("checksums_checked") > 0) | F.col("money_checked"), "partially_verified")
        .otherwise("unverified")
    )


def codes_of(severity: str = "error") -> Column:
    """Sorted distinct codes of the issues of a severity, joined."""
    chosen = F.transform(F.filter("issues", lambda x: x["severity"] == severity), lambda x: x["code"])
    return F.array_join(F.array_sort(F.array_distinct(chosen)), "; ")


# The rules of the record types in the data.
SPECS = {
    "invoices_upd": Spec(
        identifiers=[{"path": "seller.inn", "kind": "inn"}, {"path": "buyer.inn", "kind": "inn"}, {"path": "seller.kpp", "kind": "kpp", "severity": "warning"}],
        money=[{"code": "INVOICE_SUM", "total": "finances.total_rub", "parts": ["finances.total_rub_no_vat", "finances.total_vat_rub"]}],
    ),
    "commercial_contracts": Spec(
        identifiers=[{"path": "party_one.inn", "kind": "inn"}, {"path": "party_two.inn", "kind": "inn"}, {"path": "party_one.ogrn", "kind": "ogrn"}, {"path": "party_two.ogrn", "kind": "ogrn"}],
        chronology=[{"before": "doc_date", "after": "term_end", "code": "CONTRACT_DATES"}],
    ),
    "legal_claims": Spec(
        identifiers=[{"path": "sender.inn", "kind": "inn"}, {"path": "recipient.inn", "kind": "inn"}],
        money=[{"code": "CLAIM_SUM", "total": "finances.total_claim_rub", "parts": ["finances.principal_debt_rub", "finances.penalty_rub", "finances.interest_rub"]}],
        bank_texts=["bank_requisites"],
        chronology=[{"before": "contract_basis_date", "after": "doc_date", "code": "CLAIM_DATES"}],
    ),
    "executive_documents": Spec(
        money=[{"code": "WRIT_SUM", "total": "finances.total_rub", "parts": ["finances.main_debt_rub", "finances.interest_penalty_rub", "finances.court_fee_rub", "finances.other_rub"]}],
    ),
    "enforcement_orders": Spec(
        money=[{"code": "ORDER_SUM", "total": "finances.total_rub", "parts": ["finances.main_debt_rub", "finances.court_costs_rub"]}],
        chronology=[{"before": "court.act_date", "after": "doc_date", "code": "ORDER_DATES"}],
    ),
    "salary_deductions": Spec(
        money=[{"code": "SALARY_SUM", "total": "finances.total_deduction_rub", "parts": ["finances.debt_amount_rub", "finances.fee_penalty_rub"]}],
        chronology=[{"before": "ip_date", "after": "doc_date", "code": "SALARY_DATES"}],
        bank={"bik": "payment_details.bik", "account": "payment_details.payment_account", "uin": "payment_details.uin", "office": "payment_details.rosp_code", "oktmo": "payment_details.oktmo", "kpp": "payment_details.recipient_kpp"},
    ),
}
# The rules of record types that the data has no table of.
MORE_SPECS = {
    "hr_orders": Spec(
        identifiers=[{"path": "employee.inn", "kind": "inn"}, {"path": "employee.snils", "kind": "snils"}, {"path": "organization_inn", "kind": "inn"}],
        chronology=[{"before": "effective_date_from", "after": "effective_date_to", "code": "CHRONO_FROM_BEFORE_TO"}],
        gate_fields={"organization_inn": 10, "employee.inn": 10, "employee.snils": 11, "doc_number": 3, "employee.salary_rub": 3},
        gate_names=["employee.full_name", "director_signatory"],
    ),
    "powers_of_attorney": Spec(
        identifiers=[{"path": "principal.inn", "kind": "inn"}, {"path": "principal.ogrn", "kind": "ogrn"}, {"path": "agent.inn", "kind": "inn"}, {"path": "agent.snils", "kind": "snils"}],
        chronology=[{"before": "issue_date", "after": "valid_until", "code": "INVALID_VALIDITY_TERM", "severity": "error"}],
        gate_fields={"principal.inn": 10, "agent.inn": 10, "agent.passport_number": 5, "doc_number": 3},
        gate_names=["principal.name", "agent.full_name"],
    ),
    "acceptance_certificates": Spec(
        identifiers=[{"path": "contractor.inn", "kind": "inn"}, {"path": "customer.inn", "kind": "inn"}],
        money=[{"code": "ACCEPTANCE_MATH_DISCREPANCY", "total": "finances.total_rub", "parts": ["finances.amount_no_vat_rub", "finances.vat_amount_rub"]}],
        chronology=[{"before": "contract_date", "after": "doc_date", "code": "CHRONO_CONTRACT_BEFORE_ACT"}],
        gate_fields={"finances.total_rub": 3, "contractor.inn": 10, "customer.inn": 10, "doc_number": 3},
        gate_names=["contractor.name", "customer.name"],
    ),
}
