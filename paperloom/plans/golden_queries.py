"""Operators whose inputs the tables lack, over small tables of published examples; the SQL states what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import evidence, identifiers, numbers, text
from paperloom.operators import audit, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    return repr(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def golden(name: str, inputs: str, kind: str, cases: list[tuple], made: Callable[..., Column]) -> None:
    """Registers a query of ``made`` over the inputs of ``cases`` (inputs..., expected) and the SQL of what is expected."""
    columns = [c.split(":")[0] for c in inputs.split(",")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], f"id:int,{inputs}")
        return rows.select("id", made(*map(F.col, columns)).alias("result"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT id::INT AS id, result::{kind} AS result FROM (VALUES " + ", ".join(f"({i}, {_sql(c[-1])})" for i, c in enumerate(cases)) + ") AS t(id, result)"


golden("q_snils", "value:string", "BOOLEAN", [("112-233-445 95", True), ("11223344595", True), ("11223344596", False), ("001-001-998 00", True), ("1122334459", False), ("", False), (None, False)], identifiers.valid_snils)
golden("q_bik", "value:string", "BOOLEAN", [("044525225", True), ("015004950", True), ("054525225", False), ("04452522", False), ("", False), (None, False)], identifiers.valid_bik)
golden("q_account_key", "account:string,bik:string", "BOOLEAN", [("30101810400000000225", "044525225", True), ("30101810400000000226", "044525225", False), ("3010181040000000022", "044525225", False), ("30101810400000000225", None, False)], identifiers.valid_account)
golden("q_bank_state", "bik:string,account:string", "VARCHAR", [("044525225", "30101810400000000225", "ok"), ("044525225", "30101810400000000226", "key"), ("44525225", "30101810400000000225", "bik"), ("044525225", "3010", "account"), (None, "30101810400000000225", "ok"), ("", None, None)], identifiers.bank_state)
golden(
    "q_currency", "value:string", "DOUBLE",
    [("100 000 руб.", 100000.0), ("45000,00 ₽", 45000.0), ("125.432,50 руб", 125432.5), ("125 432.50", 125432.5), ("100 000 (сто тысяч) руб. 50 коп.", 100000.5), ("5000 руб 25 копеек", 5000.25), (None, None), ("-", None), ("нет", None), ("0", 0.0), ("0.00 руб", 0.0), ("044525225", None), ("11223344595", None), ("7707083893", None), ("044525225 руб.", 44525225.0), ("-50,00 руб", -50.0), ("25 %", None)],
    numbers.currency,
)
golden("q_percentage_words", "value:string", "DOUBLE", [("1/4 заработка", 25.0), ("1/2", 50.0), ("2/3 дохода", 66.67), ("1/3", 33.33), ("10701/16/3001-ИП", None), ("четверть дохода", 25.0), ("двух третей заработка", 66.67), ("двадцать пять процентов", 25.0), ("70 процентов", 70.0), ("50% ежемесячно", 50.0), ("без удержаний", None)], numbers.percentage)
golden("q_number_strokes", "value:string", "VARCHAR", [("107011630001", "107011630001"), ("107011630001-ИП", "10701/16/30001-ИП"), ("№ 107011630001-ИП", "10701/16/30001-ИП"), ("10701163001-ИП", "10701/16/3001-ИП"), ("10701/16/3001-ИП", "10701/16/3001-ИП"), ("№ 64947/18/23023-ИП", "№ 64947/18/23023-ИП"), ("ФС006655763", "ФС006655763"), ("Вх. № 514", "Вх. № 514"), ("32230001160010701004", "32230001160010701004")], identifiers.case_file_number)
golden(
    "q_secrets", "value:string", "VARCHAR",
    [("sk-12345678abcdef", "sk-12345678***REDACTED***"), ("Bearer abcdefghijk.lmn", "Bearer abcdefgh***REDACTED***"), ("key=abcdefghi", "key=***REDACTED***"), ("паспорт 4510 123456 выдан", "паспорт 4510 ***REDACTED*** выдан"), ("ИНН 7707083893", "ИНН 7707083893"), ("sk-short", "sk-short"), (None, None)],
    text.masked,
)
_VERDICT = "Суд постановил: взыскать с ООО 'Должник' в пользу ПАО 'Сбербанк' основной долг в размере 250 000 руб. 00 коп., проценты в сумме 15 000 руб., а также расходы по оплате госпошлины 6 000 руб. Итого к взысканию: 271 000 руб."
_ORDER = "Постановление судебного пристава: обратить взыскание на заработную плату должника в размере 50% ежемесячно до погашения общей суммы задолженности в размере 84 500 руб. 50 коп."
golden("q_stated_totals", "value:string", "DOUBLE", [(_VERDICT, 271000.0), (_ORDER, 84500.5), ("Договор без сумм", None), ("взыскать неустойку 500 руб. и штраф 300 руб.", 500.0), ("", None), (None, None)], lambda v: numbers.amounts_in(v)["total_rub"])
golden("q_stated_parts", "value:string", "VARCHAR", [(_VERDICT, "250000.0|6000.0|15000.0"), (_ORDER, "||"), ("", "||")], lambda v: F.concat_ws("|", *[F.coalesce(numbers.amounts_in(v)[n].cast("string"), F.lit("")) for n in ("main_debt_rub", "court_fee_rub", "penalty_rub")]))
golden(
    "q_presence", "value:string,body:string", "BOOLEAN",
    [("7707083893", "ИНН 7707083893 банка", True), ("770708389", "ИНН 7707083893 банка", False), ("А40-12345/2019", "дело № А40-12345/2019 от", True), ("100", "сумма 100 рублей", True), ("100.0", "сумма 100 рублей", True), ("1000.0", "сумма 100 рублей", False), ("224616.01", "итого 224 616,01 руб.", True), ("Иванов", "взыскать с Иванова Ивана", True), ("Иванов", "Ивановский район", False), ("Иван", "Иванов", False)],
    evidence.present,
)
_KINDS = [("numeric", "1 234,56", "1234.56", 100.0), ("numeric", "240000", "240000", 100.0), ("inn", "7707083893", "7707083893", 100.0), ("inn", "7707083893", "7707083894", 0.0), ("date", "15.01.2023", "2023-01-15", 100.0), ("text", "Иск", "иск", 100.0), ("exact", "А-1", "А-2", 0.0), ("text", None, None, None), ("text", None, "x", 0.0), ("text", "x", None, 0.0)]
golden("q_field_scores", "kind:string,pred:string,truth:string", "DOUBLE", _KINDS, lambda k, p, t: F.coalesce(*[F.when(k == kind, scoring.field_score(p, t, kind)[0]) for kind in ("numeric", "inn", "date", "text", "exact")]))
golden("q_similar_texts", "pred:string,truth:string", "DOUBLE", [("240000", "2400000", 92.31), ("", None, 100.0), ("a", "", 0.0), ("Иск", "иск", 100.0)], text.similarity_score)
golden("q_requisites", "value:string", "VARCHAR", [("р/с 40702810400000000001, БИК 044525225, КПП 770701001 в ПАО Сбербанк", "40702810400000000001|044525225|770701001"), ("р/с не указан", "||"), ("", "||")], lambda v: F.concat_ws("|", *[F.coalesce(text.requisites(v)[n], F.lit("")) for n in ("payment_account", "bik", "kpp")]))
golden("q_office_codes", "number:string,explicit:string,body:string", "VARCHAR", [("48034/16/23825-ИП", None, None, "23825"), ("48034/16/23825-ИП", "25013", None, "25013"), ("", None, "Код 25013 отдела", "25013"), ("", "12", "нет", "12"), (None, None, None, "")], lambda n, e, b: text.office_code(n, e, b))


_PAYMENT = "payment_details:struct<bik:string,payment_account:string,uin:string,rosp_code:string,oktmo:string,recipient_kpp:string,recipient:string>"
_BANK = audit.Spec(bank={"bik": "payment_details.bik", "account": "payment_details.payment_account", "uin": "payment_details.uin", "office": "payment_details.rosp_code", "oktmo": "payment_details.oktmo", "kpp": "payment_details.recipient_kpp"}, bank_names=["payment_details.recipient"], doc_refs=["base_number"])
_BANK_CASES = [
    (("044525225", "30101810400000000225", "32225013160010701004", "25013", "05701000", "254301001", ""), "12345678", 3, 3, ""),
    (("044525225", "30101810400000000226", None, None, "057010", "2543010", "ООО"), "1234567", 2, 1, "INVALID_BANK_ACCOUNT; INVALID_DOC_REF_NUMBER; INVALID_KPP; INVALID_OKTMO"),
    (("044525225", "30101810400000000226", None, None, None, None, "ГРКЦ Банка России"), None, 2, 1, "BANK_ACCOUNT_UNVERIFIED"),
    (("999999999", None, "32225013160010701004", "11111", None, None, None), None, 2, 0, "INVALID_BIK; UIN_ROSP_MISMATCH"),
    ((None, "30101810400000000225", None, None, None, None, None), None, 0, 0, "ACCOUNT_WITHOUT_BIK"),
    ((None,) * 7, None, 0, 0, ""),
]


def q_bank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(_BANK_CASES)], f"id:int,{_PAYMENT},base_number:string")
    codes = F.array_join(F.array_sort(F.array_distinct(F.transform("issues", lambda x: x["code"]))), "; ")
    return audit.audited(df, _BANK).select("id", "checksums_checked", "checksums_ok", codes.alias("codes"))


QUERIES["q_bank_audit"] = q_bank_audit
ORACLES["q_bank_audit"] = "SELECT id::INT AS id, a::INT AS checksums_checked, b::INT AS checksums_ok, codes FROM (VALUES " + ", ".join(f"({i}, {c[2]}, {c[3]}, {_sql(c[4])})" for i, c in enumerate(_BANK_CASES)) + ") AS t(id, a, b, codes)"

_WRIT = audit.Spec(money=[{"code": "WRIT_MATH", "total": "total", "parts": ["main", "fine", "fee"]}, {"code": "SECOND", "total": "total", "parts": ["main", "other"]}], identifiers=[{"path": "inn", "kind": "inn"}])
# total, main, fine, fee, other, inn, resolution, recovered, expected: verdict and codes of errors
_LADDER_CASES = [
    ("224616.01", "157611.62", "7004.39", "60000.00", None, "7707083893", 300, False, "verified", ""),
    ("999999", "157611.62", "7004.39", "60000.00", None, "7707083893", 300, False, "discrepancy", "WRIT_MATH"),
    ("120000", "100000", "20000", None, None, None, None, None, "partially_verified", ""),
    ("120000", "100000", "двадцать", None, None, "7707083893", None, None, "discrepancy", "WRIT_MATH"),
    ("много", "100000", "20000", None, None, None, None, None, "discrepancy", "WRIT_MATH"),
    ("120000", "100000", None, None, "20000", "7707083893", None, None, "verified", ""),
    ("120000", "100000", None, None, "30000", None, None, None, "discrepancy", "SECOND"),
    ("120000", "100000", "20000", None, "1", "7707083893", None, None, "verified", ""),
    ("120000", "100000", "20000", None, None, "7707083893", 100, None, "low_resolution", ""),
    ("120000", "100000", "20000", None, None, "7707083893", 0, True, "heuristic", ""),
    (None, "1", "2", None, None, None, None, None, "unverified", ""),
    ("1", None, None, None, None, "7707083894", None, None, "discrepancy", "INN_CHECKSUM"),
]


def q_verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, *c[:8]) for i, c in enumerate(_LADDER_CASES)], "id:int,total:string,main:string,fine:string,fee:string,other:string,inn:string,dpi:int,recovered:boolean")
    return audit.audited(df, _WRIT, dpi=F.col("dpi"), recovered=F.col("recovered")).select("id", "verdict", audit.codes_of().alias("codes"))


QUERIES["q_verdict_ladder"] = q_verdict_ladder
ORACLES["q_verdict_ladder"] = "SELECT id::INT AS id, verdict, codes FROM (VALUES " + ", ".join(f"({i}, {_sql(c[8])}, {_sql(c[9])})" for i, c in enumerate(_LADDER_CASES)) + ") AS t(id, verdict, codes)"

_GATE = audit.Spec(gate_fields={"inn": 10, "amount": 3, "again": 10}, gate_names=["party"], gate_authorities=["court"])
_BODY = "Решением Дяфетского городского суда с ООО Ромашка ИНН 7707083893 взыскано 1 500,00 руб."
_GATE_CASES = [
    (_BODY, "7707083893", 1500.0, None, "Ромашка, ООО", "Дяфетский горсуд", "unverified", ""),
    (_BODY, "7707083894", 15000.0, "7707083894", "Василёк", "Качурский суд", "discrepancy", "amount; court; inn; party"),
    (_BODY, "123", 0.0, None, "ООО", "суд", "unverified", ""),
    ("коротко", "7707083894", 1.0, None, "Василёк", None, "gate_not_executed", ""),
    (None, "7707083894", 1.0, None, None, None, "gate_not_executed", ""),
]


def q_gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(_GATE_CASES)], "id:int,body:string,inn:string,amount:double,again:string,party:string,court:string")
    out = audit.audited(df, _GATE, raw_text=F.col("body"), gate_expected=F.lit(True))
    fields = F.transform(F.filter("issues", lambda x: x["code"] == "NOT_IN_TEXT"), lambda x: x["field_name"])
    return out.select("id", "verdict", F.array_join(F.array_sort(fields), "; ").alias("fields"))


QUERIES["q_gate_audit"] = q_gate_audit
ORACLES["q_gate_audit"] = "SELECT id::INT AS id, verdict, fields FROM (VALUES " + ", ".join(f"({i}, {_sql(c[6])}, {_sql(c[7])})" for i, c in enumerate(_GATE_CASES)) + ") AS t(id, verdict, fields)"
