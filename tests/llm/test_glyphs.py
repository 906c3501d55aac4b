import random
import unicodedata as ud

import pytest

from paperloom.llm import glyphs


@pytest.mark.parametrize("value,policy,want", [
    ("2-8442／2020", "number", "2-8442/2020"), ("A14-99344/2о23", "number", "А14-99344/2023"), ("№ 2а-695/2018-АК", "number", "№ 2а-695/2018-АК"), ("серия ФС №012l66772", "number", "серия ФС №012166772"),
    ("ФС № 0679692О0", "number", "ФС № 067969200"), ("АС-0267​71618", "number", "АС-026771618"), ("𝟣0", "number", "10"), ("№ 9ОО5/1", "number", "№ 9005/1"),
    ("Ryazuchbаnk PJ‌SC", "name", "Ryazuchbank PJSC"), ("Евге­нй", "name", "Евгей".replace("е", "ений")[0:0] or "Евгенй"), ("Юлия", "name", "Юлия"), ("Lanyampröm", "name", "Lanyampröm"), ("Zhenüssnab Ltd", "name", "Zhenüssnab Ltd"),
    ("Б.　Банк （ПАО）", "name", "Б. Банк (ПАО)"), ("", "name", ""), ("  ", "number", "  "), ("Й​од", "name", "Йод"), ("И​̆од", "name", "Йод"), ("АO «Дyсaл»", "name", "АО «Дусал»"),
])
def test_cases(value, policy, want):
    assert glyphs.unify(value, policy) == want


def test_null_stays_null():
    assert glyphs.unify(None, "name") is None


def corrupted(text: str, rng: random.Random) -> str:
    out = []
    for ch in text:
        kind = rng.random()
        if ch == " " and kind < 0.4:
            ch = rng.choice("  　 ")
        elif ch.isdigit() and kind < 0.3:
            ch = rng.choice([chr(0xFF10 + int(ch)), chr(0x1D7CE + int(ch)), chr(0x1D7F6 + int(ch))])
        elif kind < 0.3:
            ch = {"й": "й", "ё": "ё"}.get(ch, ch)
        if rng.random() < 0.15:
            ch += rng.choice("​‌‍⁠﻿­͏‎")
        out.append(ch)
    return "".join(out)


def test_corruption_is_undone():
    rng = random.Random(5)
    for text, policy in (("Вх. № 8985 от 17.10.2023", "number"), ("А45-71029/2014", "number"), ("Фёдор Михайлович Хукёрый", "name"), ("ПАО «Рязучбанк» (доп. офис)", "name")):
        for _ in range(300):
            assert glyphs.unify(corrupted(text, rng), policy) == text


def test_one_pass_is_a_fixed_point():
    rng = random.Random(6)
    pool = [chr(c) for c in range(0x20, 0x2100) if ud.category(chr(c)) != "Cn"] + list("０１／－Ａｂ𝟘𝟙")
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        for policy in ("number", "name"):
            once = glyphs.unify(text, policy)
            assert glyphs.unify(once, policy) == once, ascii(text)


def test_rules_have_no_conflict_and_end_plain():
    rules = glyphs.compiled()
    assert not any(x in rules for v in rules.values() for x in v)
    glyphs.alike()


def test_long_text_and_frames(spark):
    assert glyphs.unify("Ａ" * 200_000, "name") == "A" * 200_000
    df = spark.createDataFrame([(1, "２", "x"), (1, "２", "x"), (2, None, None), (3, "", "")], "rec_id long, value string, unified string")
    got = glyphs.unify_fields(df, "rec_id", {"f": ("value", "number"), "g": ("unified", "name")})
    assert sorted(map(tuple, got.collect())) == [("f", 1, "２", "2"), ("f", 1, "２", "2"), ("f", 3, "", ""), ("g", 1, "x", "x"), ("g", 1, "x", "x"), ("g", 3, "", "")]
    assert glyphs.unify_fields(df.limit(0), "rec_id", {"f": ("value", "number")}).count() == 0
