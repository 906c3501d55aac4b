import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import blanks, dates, evidence, identifiers, numbers, paths, text


def values(spark, make, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def check(spark, make, cases):
    assert values(spark, make, list(cases)) == list(cases.values())


def test_loose_numbers(spark):
    check(spark, numbers.loose_number, {"1234.56": 1234.56, "1 234,56": 1234.56, "1,234.56": 1234.56, "1.234,56": 1234.56, "12": 12.0, "-50,00": -50.0, "abc": None, None: None, "": None, "1,234": 1234.0, "1.2E7": 1.2e7})


def test_currency(spark):
    check(spark, numbers.currency, {
        "100 000 руб.": 100000.0, "45000,00 ₽": 45000.0, "125.432,50 руб": 125432.5, "125 432.50": 125432.5, "100 000 (сто тысяч) руб. 50 коп.": 100000.5,
        "5000 руб 25 копеек": 5000.25, "-": None, "нет": None, None: None, "0": 0.0, "0.00 руб": 0.0, "044525225": None, "11223344595": None,
        "7707083893": None, "044525225 руб.": 44525225.0, "-150 000": -150000.0, "": None, "50%": None, "12 345,6 руб": 12345.6,
    })


def test_percentages(spark):
    check(spark, numbers.percentage, {"1/4 заработка": 25.0, "1/2": 50.0, "2/3 дохода": 66.67, "1/3": 33.33, "10701/16/3001-ИП": None, "50% ежемесячно": 50.0, "70 процентов": 70.0, "две трети": 66.67, "одну треть": 33.33, "": None, None: None})


def test_amounts_in_running_text(spark):
    found = numbers.amounts_in(F.col("v"))
    df = spark.createDataFrame([("Взыскать основной долг 250 000 руб., пени 15 000 руб., госпошлину 6 000 руб.",), ("Удержать 84 500,50 руб. из заработка",), ("ничего",), (None,), ("",)], "v string")
    rows = [tuple(r) for r in df.select(*found.values()).collect()]
    assert rows[0] == (271000.0, 250000.0, 6000.0, 15000.0)
    assert rows[1] == (84500.5, None, None, None)
    assert rows[2:] == [(None,) * 4] * 3


def test_dates(spark):
    check(spark, dates.flexible_date, {"21/04/2016": dt.date(2016, 4, 21), "01/02/2015": dt.date(2015, 2, 1), "21/13/2016": None, "10701/16/3001-ИП": None, "15 января 2023 г.": dt.date(2023, 1, 15), "2023-02-31": None, "05.06.2020": dt.date(2020, 6, 5), "": None, None: None})
    check(spark, dates.iso_text, {"5.6.2020": "2020-06-05", "2020/6/5": "2020-06-05", "31.02.2024": "2024-02-31", "б/д": "б/д", "": "", None: ""})


def test_identifiers(spark):
    check(spark, identifiers.valid_inn, {"7707083893": True, "7707083890": False, "500100732259": True, "12345": False, None: False, "": False})
    check(spark, identifiers.valid_snils, {"112-233-445 95": True, "112-233-445 00": False, "001-001-997 00": True, None: False})
    check(spark, identifiers.valid_ogrn, {"1027700132195": True, "1027700132190": False, None: False})
    check(spark, identifiers.valid_bik, {"044525225": True, "015004950": True, "124525225": False, None: False})
    check(spark, lambda v: identifiers.valid_account(v, F.lit("044525225")), {"30101810400000000225": True, "30101810400000000226": False, None: False})
    check(spark, identifiers.case_file_number, {"107011630001-ИП": "10701/16/30001-ИП", "10701163001-ИП": "10701/16/3001-ИП", "Вх. № 514": "Вх. № 514", None: None})
    check(spark, identifiers.file_number_score, {"10701/16/3001-ИП": 100.0, "10701": 80.0, "abc": 30.0})


def test_blanks_keep_their_four_meanings(spark):
    rows = [None, "", "  ", "None", "none", "0", "0.0", "x"]
    assert values(spark, blanks.is_blank, rows) == [True, True, True, True, True, False, False, False]
    assert values(spark, blanks.is_export_blank, rows) == [True, True, True, True, False, False, False, False]
    assert values(spark, blanks.is_unrecovered, rows) == [True, True, True, True, False, True, True, False]
    assert values(spark, blanks.is_white, rows) == [True, True, True, False, False, False, False, False]


def test_similarity_is_that_of_matching_blocks(spark):
    df = spark.createDataFrame([("240000", "2400000"), ("", None), ("a", ""), ("Иск", "иск")], "a string, b string")
    assert [r[0] for r in df.select(text.similarity_score(F.col("a"), F.col("b"))).collect()] == [92.31, 100.0, 0.0, 100.0]


def test_text_readers(spark):
    check(spark, lambda v: text.base_document(v)["number"], {"Исполнительный лист № ФС00001234 от 20.01.2016": "ФС00001234", "ВС (12-3)": "12-3", None: "", "": ""})
    check(spark, lambda v: text.base_document(v)["date"], {"Исполнительный лист № ФС00001234 от 20.01.2016": "20.01.2016", None: ""})
    check(spark, lambda v: text.payment_details(v)["bik"], {"БИК: 044525225": "044525225", "x": None, None: None})
    check(spark, text.masked, {"sk-abcdefgh1234": "sk-abcdefgh***REDACTED***", "token=abc": "token=abc", "4510 123456": "4510 ***REDACTED***", "ИНН 7707083893": "ИНН 7707083893", None: None})
    check(spark, text.file_stem, {"a/b:c": "a_b_c", "con": "_con", "": "unnamed", None: "unnamed", "x" * 90: "x" * 60})
    check(spark, lambda v: v.rlike(text.glob_pattern("*приказ*прием*")), {"приказ о прием": True, "прием приказ": False})
    check(spark, lambda v: v.rlike(text.glob_pattern("*upd*")), {"a_upd.pdf": True, "updated": False})


def presence(value: str, body: str) -> bool:
    """Plain Python for values with letters: separators, endings, one stray character."""
    low = re.sub(r"\s+", " ", body.lower().replace("ё", "е")).strip()
    stem = re.sub(r"\s", "", value.lower().replace("ё", "е"))
    edge, after, gap = r"(?<![0-9A-Za-zА-Яа-яЁё])", r"(?![0-9A-Za-zА-Яа-яЁё])", evidence.SEPARATORS
    ways = [gap.join(map(re.escape, stem))]
    if len(stem) >= 5:
        ways.append(ways[0] + "[а-яё]{0,3}")
    if len(stem) >= 7 and stem.endswith(("ий", "ый", "ой")):
        ways.append(gap.join(map(re.escape, stem[:-2])) + "[а-яё]{1,4}")
    if len(stem) >= 6 and stem[-1] in "ая":
        ways.append(gap.join(map(re.escape, stem[:-1])) + "[а-яё]{1,3}")
    if len(stem) >= 6:
        ways.append(".?".join(map(re.escape, stem)))
    return any(re.search(edge + w + after, low) for w in ways)


def test_evidence(spark):
    cases = [
        ("7707083893", "ИНН 7707083893 банка", True), ("770708389", "ИНН 7707083893 банка", False), ("А40-12345/2019", "дело № А40-12345/2019 от", True), ("100.0", "сумма 100 рублей", True),
        ("1000.0", "сумма 100 рублей", False), ("224616.01", "итого 224 616,01 руб.", True), ("5075.0", "5 075,00", True), ("Иванов", "взыскать с Иванова Ивана", True), ("Иванов", "Ивановский район", False),
        ("Иван", "Иванов", False), ("Римский", "Римского Петра", True), ("Ромашка", "фирмы «Ромашки»", True), ("", "текст", True), (None, "текст", True), ("слово", None, False), ("слово", "", False),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, v string, t string")
    got = [r[0] for r in df.orderBy("i").select(evidence.present(F.col("v"), F.col("t"))).collect()]
    assert got == [c[2] for c in cases]
    for v, t, want in cases:
        if v and t and re.search("[а-яА-Я]", v):
            assert presence(v, t) == want


def test_evidence_over_documents_agrees_with_plain_python(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("case_number IS NOT NULL AND text IS NOT NULL")
    for r in docs.select("case_number", "text", evidence.present(F.col("case_number"), F.col("text")).alias("p")).collect():
        if re.search(r"[^\W\d_]", r["case_number"]):
            assert r["p"] == presence(r["case_number"].strip(), r["text"]), r["case_number"]


def test_paths(spark):
    df = spark.createDataFrame([(1, (None, "x"), "", [("p", 1.0), None])], "id long, a struct<b:string,c:string>, d string, e array<struct<n:string,v:double>>")
    assert df.select(paths.at(df.schema, "a.b|d|a.c")).first()[0] == ""
    assert tuple(df.select(paths.present_at(df.schema, "a.b|d|a.c")).first()[0]) == ("x", "a.c")
    assert not paths.declared(df.schema, "a.z") and paths.declared(df.schema, "e.n")
    assert [tuple(r)[1:] for r in paths.leaves(df, "id").collect()] == [("a.b", None), ("a.c", "x"), ("d", ""), ("e.0.n", "p"), ("e.0.v", "1.0")]
    assert paths.with_value(df, "a.b", F.lit("new")).first()["a"]["b"] == "new"
    v = spark.sql("""SELECT parse_json('{"a": {"b": null, "c": 5}}') AS v""")
    assert tuple(v.select(paths.in_variant(F.col("v"), "a.b|a.c"), paths.declared_in_variant(F.col("v"), "a.b"), paths.declared_in_variant(F.col("v"), "a.z")).first()) == ("5", True, False)


@pytest.mark.parametrize("pred,truth,near", [(100.0, 100.0, 100.0), (None, None, 100.0), (None, 1.0, 0.0), (90.0, 100.0, 90.0), (2400000.0, 240000.0, 0.0)])
def test_proximity(spark, pred, truth, near):
    df = spark.createDataFrame([(pred, truth)], "p double, t double")
    assert df.select(numbers.proximity(F.col("p"), F.col("t"))).first()[0] == near


def test_amounts_are_found_in_linear_time(spark):
    """Long lines without amounts, long runs of digits, many amounts: all end soon, and the first of each kind counts."""
    long = "взыскать с " + "должника " * 20_000
    many = "основной долг 5 руб. " * 5_000
    rows = [long + "в размере 7 руб.", long, "1 " * 50_000, many, "9" * 100_000 + " руб"]
    assert values(spark, lambda v: numbers.amounts_in(v)["total_rub"], rows)[:4] == [7.0, None, None, 5.0]


def test_placeholders_and_forms(spark):
    check(spark, identifiers.no_kind, {"N/A": True, "не указано": True, "Неопределённый документ": True, "": True, None: True, "Судебный приказ": False})
    check(spark, lambda v: identifiers.well_formed(v, "blank_series"), {"ФС": True, "фс": True, "Ф1": False, "": None, None: None})
    check(spark, lambda v: identifiers.well_formed(v, "oktmo"), {"05701000": True, "05701000001": True, "0570100": False, " ": None})
