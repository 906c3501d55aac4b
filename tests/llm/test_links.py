import random

import pytest
from pyspark.sql import functions as F

from paperloom.llm import address_links, name_links, names, postal, queries
from paperloom.llm.edit import osa


@pytest.mark.parametrize("value,kinds,want", [
    ("Судебный пристав-исполнитель Кягодина  Зинаида Д.", "p", ("p", "кягодина", "зинаида", "д.")),
    ("Нижоденко И. Г., судебный пристав-исполнитель", "p", ("p", "нижоденко", "и.", "г.")),
    ("Бачягевича Алексея Семёновича", "p", ("p", "бачягевич", "алексеы", "семенович")),
    ("Кягодиной Полины Григорьевны (СПИ)", "p", ("p", "кягодина", "полина", "григоревна")),
    ("ЖенамевичР.Д.", "p", ("p", "женамевич", "р.", "д.")),
    ("Khukarykh Darya Alekseevna", "po", ("p", "хукарых", "даря", "алексеевна")),
    ("Юлия Петровна Химукова", "po", ("p", "химукова", "юлия", "петровна")),
    ("Акционерным обществом «Лемунлайн»", "po", ("o", "лемунлаын", "ао", "")),
    ("Публичное акционерное общество «Рязучбанк»", "pot", ("o", "рязучбанк", "пао", "")),
    ("Банк Рязуч (ПАО)", "pot", ("o", "рязучбанк", "пао", "")),
    ("МИФНС № 13 по Приозёрной области", "pot", ("t", "оприозерн", "", "")),
    ("Городской суд г. Дяфетск", "c", ("c", "дяфет", "", "")),
    ("Дяфетский городской суд Северополянского края", "c", ("c", "дяфет", "ксеверополян", "")),
])
def test_readings(value, kinds, want):
    n = names.read(value, kinds)
    assert (n.kind, n.cores[0], n.slot1, n.slot2) == want


@pytest.mark.parametrize("value", [None, "", "   ", "***", "[скрыто]", "«...»", "Гражданин N", "---"])
def test_stand_ins_are_nobody(value):
    assert names.read(value, "pot") is None


def test_automaton_finds_all_neighbours():
    rng = random.Random(4)
    words = {"".join(rng.choice("абвг") for _ in range(rng.randint(0, 8))) for _ in range(500)}
    trie = {}
    for w in words:
        name_links.add(trie, w)
    for w in rng.sample(sorted(words), 80):
        for most in (0, 1, 2, 3):
            assert dict(name_links.Automaton(w, most).walk(trie)) == {x: osa(w, x, most) for x in words if osa(w, x, most) <= most}


def slipped(rng, w, times, letters="х"):
    for _ in range(times):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        c = rng.choice(letters)
        w = w[:i] + (c + w[i + 1 :], w[i + 1 :], c + w[i:], w[i + 1 : i + 2] + w[i] + w[i + 2 :])[kind]
    return w


def pairs(df):
    return {(r["core"], r["other"], r["slips"]) for r in df.collect()}


def brute(entries, queries):
    return {(a, b, osa(a, b, 2)) for a in queries for b in entries if a != b and osa(a, b, 2) <= name_links.slips(max(len(a), len(b)))}


def test_trie_join_misses_no_pair(spark, monkeypatch):
    """Slips at both ends, in the middle of short and in long cores; shards cut by their last letters and into blocks."""
    rng = random.Random(11)
    words = {"ивин", "иивн", "ивн", "абвг", "авбг", "абвгдежз", "бавгдезж", "абхгдехз", "абвгдежзик", "хабвгдежзих"}
    long = "".join(rng.choice("абвгдежз") for _ in range(150))
    words |= {long, "х" + long + "х", long[:149], long[1:149], long[:75] + long[76] + long[75] + long[77:]}
    for _ in range(60):
        word = "".join(rng.choice("абвгдежз") for _ in range(rng.randint(3, 14)))
        words |= {word, *(slipped(rng, word, 2) for _ in range(5))}
    words = sorted(words)
    queries = [w for i, w in enumerate(words) if i % 3]
    entries = [w for i, w in enumerate(words) if i % 4]
    frame = lambda ws: spark.createDataFrame([("s", w) for w in ws], "space string, core string")
    want = brute(entries, queries)
    got = name_links.neighbours(frame(entries), frame(queries))
    assert pairs(got) == want and got.count() == len(want)
    monkeypatch.setattr(name_links, "TRIE", 5)
    assert pairs(name_links.neighbours(frame(entries), frame(queries))) == want
    assert name_links.neighbours(frame(words).limit(0), frame(words)).count() == 0


def test_shards_stay_whole_where_their_partitions_are_not_merged(spark):
    """The join that drops shards of one core turns out small, and its partitions are read where they were written."""
    rng = random.Random(8)
    words = [(str(i), "".join(rng.choice("абвгдезиклмнопрст") for _ in range(8)), rng.randrange(8)) for i in range(1500)]
    df = spark.createDataFrame([(s, x) for s, w, k in words for x in (w, w[:k] + w[k + 1 :])], "space string, core string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert name_links.neighbours(df, df).count() == 2 * len(words)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spaces_do_not_meet(spark):
    df = spark.createDataFrame([("a", "абвгд"), ("b", "абвге"), (None, "абвг"), ("a", None)], "space string, core string")
    assert name_links.neighbours(df, df).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_bounded_typing_cost_is_that_of_the_full_table(most):
    rng = random.Random(5)
    for _ in range(400):
        w = "".join(rng.choice("абвгде") for _ in range(rng.randint(4, 9)))
        noisy = slipped(rng, w, most, "абвгде")
        cost = names.typo_cost(noisy, w)
        assert osa(noisy, w, 4) <= cost


def linked(spark, rows, kinds="pot"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "entity int, name string")
    out = name_links.entities(name_links.spellings({"f": (df, "name", kinds)}))
    return {tuple(r)[1:] for r in name_links.pairs_of(out).collect()}


def test_variants_link_and_namesakes_do_not(spark):
    one = ["Кягодина Зинаида Дмитриевна", "Кягодина З.Д.", "гр. Кягодина З.Д.", "Зинаида Дмитриевна Кягодина", "КЯГОДИНА ЗИНАИДА ДМИТРИЕВНА", "Кягодина Зиеаида Дмитриевна", "Kyagodina Zinaida Dmitrievna", "Кягодиной Зинаиды Дмитриевны"]
    other = ["Кягодина Полина Григорьевна", "Кягодина П.Г."]
    firm, sister, form = ["ПАО «Рязучбанк»", "Банк Рязуч (ПАО)", "пао рязучбанк", "Ryazuchbank PJSC", "ПАО «Рязчубанк»"], ["ПАО «Рязучбанк-Сервис»"], ["ООО «Рязучбанк»", "Рязучбанк ООО"]
    got = linked(spark, [*one, *other, *firm, *sister, *form, None, "", " ", "***", one[0]])
    want = {tuple(sorted((a, b))) for group in (one, other, firm, sister, form) for a in group for b in group if a != b}
    assert got == want


def test_courts(spark):
    a = ["Дяфетский городской суд Северополянского края", "Дяфетским городским судом", "Городской суд г. Дяфетск", "Дяфетский горсуд"]
    b, c = ["Дяфетский районный суд Северополянского края", "Дяфетский р/с"], ["Судебный участок № 4 Дяфетского района Северополянского края", "Мир. судья уч. № 4 Дяфетского р-на"]
    want = {tuple(sorted((x, y))) for group in (a, b, c) for x in group for y in group if x != y}
    assert linked(spark, [*a, *b, *c, "Судебный участок № 5 Дяфетского района Северополянского края"], "c") == want


def test_names_of_no_rows_and_long_ones(spark):
    assert linked(spark, []) == set()
    assert linked(spark, ["Ж" * 5000, "Ж" * 2500 + "аба" + "Ж" * 2500]) == set()
    assert len(linked(spark, ["Ж" * 5000, "Ж" * 5001])) == 1


def test_orders_of_words(spark):
    firm = ["ООО «Вега Строй Плюс»", "ООО «Плюс Вега Строй»", "«Строй-Плюс-Вега», ООО", "ООО «Плюс Веега Строй»"]
    pair = ["АО «Строй-Ланас»", "АО «Ланас-Строй»"]
    many = ["ПК «Альфа Бета Гамма Дельта Омега»", "ПК «Омега Дельта Бета Гамма Альфа»"]
    person = ["Гизатуллин Ильдар Ренатович", "Ильдар Ренатович Гизатуллин", "Гизатуллин И.Р.", "И.Р. Гизатуллин", "Гизатуллина Ильдара Ренатовича"]
    want = {tuple(sorted((a, b))) for group in (firm, pair, many, person) for a in group for b in group if a != b}
    assert linked(spark, [*firm, *pair, *many, *person, "АО «Ланас»"]) == want


def test_links_do_not_depend_on_how_often_a_slip_occurs(spark):
    right, wrong = "Кягодина Зинаида Дмитриевна", "Кяогдина Зинаида Дмитриевна"
    posts = ["", "СПИ ", "гр. ", "ведущий СПИ ", "старший "]
    for n in (1, 5):
        rows = [p + right for p in posts] + [p + wrong for p in posts[:n]]
        assert linked(spark, rows + [wrong] * 50) == {tuple(sorted((a, b))) for a in rows for b in rows if a != b}


def test_namesakes_stay_apart(spark):
    people = [f"Петров {a} {b}" for a in ("Иван", "Игорь", "Андрей") for b in ("Иванович", "Олегович")]
    assert linked(spark, [*people, "Петров И.О."]) <= {tuple(sorted((a, "Петров И.О."))) for a in people if "Олегович" in a}


def test_chains_of_any_length_have_one_root(spark):
    parent = spark.createDataFrame([(str(i), str(max(i - 1, 0))) for i in range(40)], "node string, up string")
    assert {r["up"] for r in name_links.roots(parent).collect()} == {"0"}
    assert name_links.roots(parent.limit(0)).count() == 0


@pytest.mark.parametrize("value,want", [
    ("948954, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 94", ("948954", "одолгоостров", "чефурпол", "ул", "нядекн", "94")),
    ("НЯДЕКНСКАЯ УЛ., Д.94, Г. ЧЕФУРПОЛЬ, ДОЛГООСТРОВСКАЯ ОБЛ, РОССИЯ", ("", "одолгоостров", "чефурпол", "ул", "нядекн", "94")),
    ("Padyatgrad, Relatnskaya ul., dom 67 s4, Dolgoostrovskaya obl., 918341", ("918341", "одолгоостров", "падятград", "ул", "релатн", "67с4")),
    ("г. Чефурполь, ул. Кягялская, дом № 77 корп. 3, лит. Б, оф. 12 (код подразделения 87492)", ("", "", "чефурпол", "ул", "кягял", "77к3лб")),
    ("проспект Сузуннский дом 39 г. Гутирград", ("", "", "гутирград", "пр", "сузунн", "39")),
    ("Белоярская область Качялполь г Вябиннский п-к 85, к. 3", ("", "обелояр", "качялпол", "пер", "вябинн", "85к3")),
    ("914741, Dyasidgorsk, Zushotksoe shosse, dom No. 34, s4", ("914741", "", "дясидгор", "ш", "зушот", "34с4")),
    ("г. Шиколкс, Нядучскиц, дом № 55-к2", ("", "", "шикол", "", "нядуч", "55к2")),
    ("РФ, Холисск, Зицатская, 140-А", ("", "", "холи", "", "зицат", "140а")),
])
def test_addresses_are_read(value, want):
    a = postal.read(value)
    assert (a.code, a.region, a.town, a.sort, a.street, a.house) == want


def test_addresses_without_a_house_are_none():
    assert [postal.read(x) for x in (None, "", "  ", "г. Холисск", "???")] == [None] * 5


def test_buildings(spark):
    one = ["948954, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 94", "НЯДЕКНСКАЯ УЛ., Д.94, Г. ЧЕФУРПОЛЬ, ДОЛГООСТРОВСКАЯ ОБЛ, РОССИЯ", "Чефурполь, Нядекнская, 94, оф. 5", "Долгоостровская обл., гор. Чефурпоь, ул. Нядекнская, дом № 94", "948954, ул Нядекнская, 94"]
    near = ["948954, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 94, корп. 1", "948954, Долгоостровская область, г. Чефурполь, пер. Нядекнский, д. 94", "948954, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 95"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*one, *near, None, "", one[0]])], "building int, address string")
    got = {tuple(r) for r in address_links.pairs_of(address_links.buildings(address_links.addresses([(df, "address")]))).collect()}
    assert got == {tuple(sorted((a, b))) for a in one for b in one if a != b}


def test_ambiguity_stays_explicit(spark):
    """An address that fits two towns is linked with neither unless its postal code tells; the candidates are listed."""
    a, b = "948954, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 94", "901234, Заболотская область, г. Чефурполь, ул. Нядекнская, д. 94"
    c = "905555, Заболотская область, г. Лумявск, ул. Нядекнская, д. 94"
    vague, coded, street, region = "Чефурполь, ул. Нядекнская, 94", "901999, Чефурполь, ул. Нядекнская, 94", "ул. Нядекнская, 94", "Заболотская обл., ул. Нядекнская, 94"
    unknown = "г. Холисск, ул. Нядекнская, д. 7"
    df = spark.createDataFrame([(x,) for x in (a, b, c, vague, coded, street, region, unknown)], "address string")
    found = address_links.matched(address_links.addresses([(df, "address")]))
    rows = {r["address"]: r for r in found.linked.collect()}
    assert len(rows) == 8 and {x: rows[x]["candidates"] for x in rows} == {a: 1, b: 1, c: 1, vague: 2, coded: 2, street: 3, region: 2, unknown: 0}
    assert {tuple(r) for r in address_links.pairs_of(found.linked).collect()} == {tuple(sorted((b, coded)))}
    assert all(rows[x]["confidence"] <= 0.5 for x in (vague, street, region)) and rows[coded]["candidate_sets"] is None
    sets: dict[str, set[str]] = {}
    for r in address_links.candidates_of(found).collect():
        sets.setdefault(r["candidate_set"], set()).add(r["building"])
    of = {x: rows[x]["building"] for x in rows}
    assert [set().union(*(sets[k] for k in rows[x]["candidate_sets"])) for x in (vague, street, region)] == [{of[a], of[b]}, {of[a], of[b], of[c]}, {of[b], of[c]}]


@pytest.mark.parametrize("times", [1, 4])
def test_slips_in_levels_link_however_often_they_occur(spark, times):
    right = [f"{i}, Долгоостровская область, г. Чефурполь, ул. Нядекнская, д. 94" for i in range(948950, 948953)]
    wrong = [f"{i}, Долгоостровская область, г. Чефурполь, ул. Нядекннская, д. 94" for i in range(948960, 948960 + times)]
    df = spark.createDataFrame([(x,) for x in right + wrong], "address string")
    assert len({r["building"] for r in address_links.buildings(address_links.addresses([(df, "address")])).collect()}) == 1


def test_no_addresses(spark):
    df = spark.createDataFrame([(None,), ("",), ("без адреса",)], "address string")
    found = address_links.matched(address_links.addresses([(df, "address")]))
    assert found.linked.count() == address_links.candidates_of(found).count() == 0


def test_queries_give_each_pair_once_in_order(spark, tiny):
    for name, a, b in (("p3_found", "name_a", "name_b"), ("p5_found", "address_a", "address_b")):
        df = queries.QUERIES[name](spark, tiny)
        assert df.where(F.col(a) >= F.col(b)).count() == 0 and df.count() == df.distinct().count() > 0


def test_very_long_values_end(spark):
    rng = random.Random(13)
    word = "".join(rng.choice("абвгдежзиклмнопрст") for _ in range(50_000))
    for value in (word, f"ООО «{word}»", f"Иванов {word} Петрович", f"{word} район", f"г. {word}, ул. {word}, д. 5", f"{word} {word} {word}"):
        for kinds in ("p", "pot", "c"):
            names.read(value, kinds)
        postal.read(value)
    assert linked(spark, [f"ООО «{word}»", f"ООО «{word[:-1]}»", f"ооо {word}"]) == {tuple(sorted(x)) for x in ((f"ООО «{word}»", f"ооо {word}"), (f"ООО «{word[:-1]}»", f"ооо {word}"), (f"ООО «{word}»", f"ООО «{word[:-1]}»"))}
