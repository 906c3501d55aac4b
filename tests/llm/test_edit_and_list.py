import random

import pytest

from paperloom.llm import canon_list, lexicon
from paperloom.llm.edit import deletes, osa, transliterate, typed_on_cyrillic, typed_on_latin, weighted_dl


def slow_osa(a: str, b: str) -> int:
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances_against_the_full_table():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("абв") for _ in range(rng.randint(0, 7))) for _ in range(2))
        want = slow_osa(a, b)
        for most in range(4):
            assert osa(a, b, most) == min(want, most + 1)
        assert weighted_dl(a, b, 99) <= want + 1e-9
        assert (weighted_dl(a, b, 1.0) <= 1.0) == (weighted_dl(a, b, 99) <= 1.0)


def test_symmetric_deletes_meet_within_the_distance():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("абвг") for _ in range(rng.randint(3, 7))) for _ in range(2))
        if osa(a, b, 2) <= 2:
            assert deletes(a, 2) & deletes(b, 2)


def test_keyboards_and_sounds_return():
    assert typed_on_cyrillic(typed_on_latin("судебный приказ")) == "судебный приказ"
    assert transliterate("щука жюри") == "shchuka zhyuri"


@pytest.fixture(scope="module")
def refs(spark, tiny):
    return [tuple(r) for r in spark.read.parquet(f"{tiny}/ref_values.parquet").collect()]


@pytest.fixture(scope="module")
def matcher(refs):
    return canon_list.Matcher(refs, {}, lexicon.ALIASES)


@pytest.fixture(scope="module")
def plain(refs):
    return canon_list.Matcher(refs, {})


def ref(refs, canonical):
    return next(r[0] for r in refs if r[2] == canonical)


DOC = "enforcement_orders.court.doc_type"
CASES = {
    "Исполнительный лист": "Исполнительный лист", "исп. лист (копия)": "Исполнительный лист", "ИЛ - оригинал": "Исполнительный лист", "b/kbcn": "Исполнительный лист",
    "лист исполнительный": "Исполнительный лист", "isp. list": "Исполнительный лист", "Bcgjkybntkmysq kbcn, le,kbrfn": "Исполнительный лист", "1) и/лист...": "Исполнительный лист",
    "Псотановление об административном правонарушении": "Постановление об административном правонарушении", "тип: вид - пост. СПИ": "Постановление судебного пристава-исполнителя",
    "Нотар. соглаш. об уплате алимен.": "Нотариальное соглашение об уплате алиментов", "CП": "Судебный приказ",
}


@pytest.mark.parametrize("value", CASES)
def test_known_ways_of_writing(matcher, refs, value):
    assert matcher.best(DOC, value)[2] == ref(refs, CASES[value])


COURT, CONTRACT, SIDE = "executive_documents.court.court_type", "commercial_contracts.contract_type", "enforcement_orders.claimant.party_type"
# ways of writing that no list has: cut, drawn together, initials, words left out, added or derived, and slips besides
RULES = [
    (DOC, "исп. лист", "Исполнительный лист"), (DOC, "и/лист", "Исполнительный лист"), (DOC, "исполлист", "Исполнительный лист"), (DOC, "ИЛ", "Исполнительный лист"), (DOC, "СП", "Судебный приказ"),
    (COURT, "райсуд", "Районный суд общей юрисдикции"), (COURT, "КСОЮ", "Кассационный суд общей юрисдикции"), (COURT, "ААС", "Арбитражный апелляционный суд"), (COURT, "АС округа", "Арбитражный суд округа"), (COURT, "гарн. воен. суд", "Гарнизонный военный суд"), (COURT, "СИП", "Суд по интеллектуальным правам"),
    (CONTRACT, "поставка", "Договор поставки"), (CONTRACT, "ДКП", "Договор купли-продажи"), (CONTRACT, "дог. субподр.", "Договор субподряда"), (CONTRACT, "комиссионный договор", "Договор комиссии"), (CONTRACT, "поручительсто", "Договор поручительства"),
    (SIDE, "тов-во собств. жилья", "Товарищество собственников жилья"), (SIDE, "госорган", "Государственный орган"), (SIDE, "прок-р", "Прокурор"), (SIDE, "юр. лицо", "Юрлицо"),
]


@pytest.mark.parametrize("field,value,want", RULES)
def test_ways_of_writing_that_follow_from_the_entry(plain, refs, field, value, want):
    assert plain.best(field, value)[2] == ref(refs, want)


@pytest.mark.parametrize("field,value", [(CONTRACT, "договор мены"), (CONTRACT, "трудовой договор"), (CONTRACT, "брачный договор"), (COURT, "верховный суд"), (COURT, "суд"), (DOC, "акт сверки"), (DOC, "доверенность"), (SIDE, "профсоюз")])
def test_what_the_list_lacks_is_a_miss_without_a_list_of_such(plain, field, value):
    assert plain.best(field, value)[2] == canon_list.MISS


def test_another_list_needs_no_vocabulary():
    """Job titles, held out of everything: cut words, initials, slips, order, the other layout."""
    titles = ["Главный бухгалтер", "Заместитель генерального директора", "Начальник отдела кадров", "Инженер по охране труда", "Водитель погрузчика", "Старший научный сотрудник"]
    m = canon_list.Matcher([(i, "f", t) for i, t in enumerate(titles, 1)], {})
    cases = {"гл. бухгалтер": 1, "главбухгалтер": 1, "бухгалтер главный": 1, "Ukfdysq ,e[ufknth": 1, "зам. ген. директора": 2, "ЗГД": 2, "нач. отдела кадров": 3, "НОК": 3, "инж. по охр. труда": 4, "инженер охраны труда": 4, "водитель погрузчка": 5, "водит. погрузч.": 5, "ст. науч. сотр.": 6, "СНС": 6, "starshiy nauchnyy sotrudnik": 6, "сторож": 0, "директор": 0}
    assert {v: m.best("f", v)[2] for v in cases} == cases


def test_glued_beginnings():
    assert canon_list.glued("исполлист", ["исполнительный", "лист"]) == (0, 1)
    assert canon_list.glued("листлист", ["исполнительный", "лист"]) is None and canon_list.glued("лист", ["лист"]) is None


@pytest.mark.parametrize("value", ["не указано", "???", "—", "Акт сверки", "акт сверик", "Претензия", "zzz qqq", "СПИ4", "см. скан (копия)", "x" * 5000])
def test_misses(matcher, value):
    assert matcher.best(DOC, value)[2] == canon_list.MISS


def test_every_alias_with_one_slip_finds_its_entry(matcher, refs):
    rng, wrong, n = random.Random(3), 0, 0
    for field, entries in lexicon.ALIASES.items():
        for canonical, aliases in entries.items():
            for alias in [canonical, *aliases.split("; ")]:
                if len(alias.replace(" ", "")) < 9:
                    continue
                i = rng.randrange(1, len(alias) - 1)
                n += 1
                wrong += matcher.best(field, alias[:i] + alias[i + 1 :])[2] != ref(refs, canonical)
    assert wrong <= 0.03 * n


def test_frames(spark, tiny):
    entries = spark.createDataFrame([(1, "f", "Городской суд"), (2, "f", "Мировой судья")], "ref_id long, field_path string, canonical string")
    values = spark.createDataFrame([("f", 1, "Городской  суд", 9), ("f", 2, None, 9), ("f", 3, " ", 9), ("f", 4, "Мировй судья", 9), ("f", 4, "Мировй судья", 9), ("f", 5, "баня", 9)], "field_path string, rec_id long, value string, ref_rank int")
    got = sorted((r["rec_id"], r["ref_id"]) for r in canon_list.map_to_list(values, entries).collect() if r["ref_id"] is not None)
    assert got == [(1, 1), (4, 2), (4, 2), (5, 0)]
    assert canon_list.map_to_list(values.limit(0), entries).count() == 0
    assert {r["ref_id"] for r in canon_list.map_to_list(values, entries.limit(0)).collect()} == {0, None}


def test_blocks_of_the_list_give_the_same(spark, tiny, monkeypatch):
    from paperloom.llm import queries

    whole = sorted(map(tuple, queries.p1_found(spark, tiny).collect()))
    monkeypatch.setattr(canon_list, "BLOCK", 20)
    monkeypatch.setattr(canon_list, "VALUES", 100)
    monkeypatch.setattr(canon_list, "MAPPED", 10)
    assert sorted(map(tuple, queries.p1_found(spark, tiny).collect())) == whole


def test_very_long_values_end(matcher):
    rng = random.Random(12)
    word = "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(100_000))
    for value in (word, "исполнительный " + word, f"{word} - {word}", "лист " * 20_000, f"({word}) x"):
        assert matcher.best(DOC, value)[2] == canon_list.MISS
