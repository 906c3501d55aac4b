"""Postal addresses read into levels: region, locality, street, house.

Each level is folded as names are (Russian and Latin spellings meet) and may be missing. The house is its number with
letter, corpus, structure and liter; rooms, offices, codes of subdivisions and the country are dropped. The postal code
is kept apart, as it may be mistaken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from paperloom.llm.edit import near_keys, osa
from paperloom.llm.glyphs import unify
from paperloom.llm.names import adjective_stem, fold, region_of

# Words for sorts of streets, in Russian and Latin, and the gender of the street's name.
STREETS = {
    "ул": ("f", "ул улица улицы ul ulitsa str street"),
    "наб": ("f", "наб набережная nab naberezhnaya"),
    "пл": ("f", "пл площадь pl ploshchad"),
    "пер": ("m", "пер переулок п-к пер-к per pereulok"),
    "пр": ("m", "пр-т пр-кт просп проспект пр pr-t pr-kt prosp prospekt"),
    "бр": ("m", "б-р бул бульвар бульв b-r bul bulvar"),
    "прд": ("m", "проезд пр-д proezd pr-d"),
    "туп": ("m", "туп тупик tup tupik"),
    "ш": ("n", "ш шос шоссе sh shos shosse"),
}
# Words for localities, the country, rooms and parts of houses.
TOWN = "г гор город gor gorod g пос поселок посёлок с село д-ня деревня"
COUNTRY = r"\b(?:россия|рф|российская федерация|russia|rossiya|rf)\b\.?"
ROOMS = r"\b(?:помещение|помещ|пом|офис|оф|кабинет|каб|квартира|кв|комната|ком|этаж|эт|pomeshchenie|pomeshch|pom|ofis|of|office|kabinet|kab|kvartira|kv|komnata|kom)\b\.?\s*№?\s*\d+[а-яa-z]?"
CODES = r"\(?\b(?:код подразделения|kod podrazdeleniya)\s*\d+\)?"
_SORTS = {w: s for s, (_, words) in STREETS.items() for w in words.split()}
_GENDER = {s: g for s, (g, _) in STREETS.items()}
_SORT = "|".join(sorted(map(re.escape, _SORTS), key=len, reverse=True))
_PARTS = {
    "к": r"(?:корпус|корп|кор|к|korpus|korp|k)\b\.?\s*№?\s*(\d+[а-яa-z]?)|\b[кk](\d+)\b",
    "с": r"(?:строение|стр|с|stroenie|str|s)\b\.?\s*№?\s*(\d+[а-яa-z]?)|\b[сs](\d+)\b",
    "л": r"(?:литера|литер|лит|litera|liter|lit)\b\.?\s*([а-яa-z])\b",
}


#: A town's word after the house: its letter isn't the house's.
_TOWN_AFTER = r"[гg]\b\.?\s*[^\W\d_]{3}"


@dataclass(frozen=True)
class Address:
    code: str
    region: str
    town: str
    sort: str
    gender: str
    street: str
    house: str


# Endings of streets' names by gender.
_ENDINGS = {"f": ("ская", "skaya"), "m": ("ский", "skiy"), "n": ("ское", "skoe")}


def _gender(word: str) -> str:
    """The gender that a street's ending shows, also where one slip leaves only one in question."""
    if re.search("(?:ая|aya)[а-яa-z]?$", word):
        return "f"
    if found := "n" if re.search("(?:ое|oe)$", word) else "m" if re.search("(?:[иоы]й|[iyo]y)$", word) else "":
        return found
    near = {g for g, ends in _ENDINGS.items() for e in ends for k in (-1, 0, 1) if len(word) > len(e) + k and osa(word[-len(e) - k :], e, 1) <= 1}
    return near.pop() if len(near) == 1 else ""


_BESIDE = {c: "".join(sorted(b for a, b in near_keys() if a == c)) for c in "ск"}
#: A locality's -ск: as it is, with a letter doubled, swapped, or one key beside.
_SK = re.compile(f"(?:с?скк?|кс|[{_BESIDE['с']}]к|с[{_BESIDE['к']}]|s?skk?|ks)$")


def town_stem(word: str) -> str:
    """The folded name of a locality without its last -ск, also where that is mistyped."""
    return fold(re.sub("с([^аеёиоуыэюя])к$", r"\1", _SK.sub("", word)))


def read(value: str | None) -> Address | None:
    """The levels of ``value``; None where it is blank or has no house."""
    low = re.sub(r"\s+", " ", unify(value, "name") or "").strip().lower()
    if not low:
        return None
    low = re.sub(r"(?<![\w-])(?:п|пер)-к(?![\w-])|(?<![\w-])(?:p|per)-k(?![\w-])", "пер", low)  # its к is no corpus
    low = re.sub(ROOMS, " ", re.sub(CODES, " ", re.sub(COUNTRY, " ", low)))
    code = ""
    if found := re.search(r"(?<!\d)(\d{6})(?!\d)", low):
        code, low = found[1], low[: found.start()] + " , " + low[found.end() :]
    region, low = region_of(low)
    parts = {}
    for key, pattern in _PARTS.items():
        found = re.search(rf"(?<![^\W\d_])(?:{pattern})", low)
        if found:
            parts[key] = fold(next(x for x in found.groups() if x))
            low = low[: found.start()] + " , " + low[found.end() :]
    number = ""
    for pattern in (rf"\b(?:дом|д|dom|d)\b\.?\s*№?\s*(\d+)(?:[\s\"«“-]*((?!{_TOWN_AFTER})[а-яa-z])(?![^\W\d_]))?[\"»”]?(?:\s*/\s*(\d+))?", rf"№?\s*\b(\d+)(?:[\s\"«“-]*((?!{_TOWN_AFTER})[а-яa-z])(?![^\W\d_]))?[\"»”]?(?:\s*/\s*(\d+))?"):
        if found := re.search(pattern, low):
            number = found[1] + fold(found[2] or "") + ("/" + found[3] if found[3] else "")
            low = low[: found.start()] + " , " + low[found.end() :]
            break
    street = sort = town = ""
    name = r"(?<![^\W\d_])([^\W\d_]{3,}(?:-[^\W\d_]+)?)"
    for pattern, at in ((rf"(?<![\w-])({_SORT})(?![\w-])\.?\s*{name}", 2), (rf"{name}\s+({_SORT})(?![\w-])\.?", 1)):
        for found in re.finditer(pattern, low):
            kind, word = found[3 - at], found[at]
            if word not in _SORTS and word not in TOWN.split():
                street, sort = word, _SORTS[kind]
                low = low[: found.start()] + " , " + low[found.end() :]
                break
        if street:
            break
    towns = "|".join(sorted(TOWN.split(), key=len, reverse=True))
    for pattern in (rf"(?<![\w-])(?:{towns})(?![\w-])\.?\s*{name}", rf"{name}\s+(?:{towns})(?![\w-])\.?"):
        for found in re.finditer(pattern, low):
            if not town and found[1] not in _SORTS and not (_gender(found[1]) and found[1] in low[found.start() + 1 :] and re.search(r"[^\W\d_]\s+$", low[: found.start()])):
                town, low = found[1], low[: found.start()] + " , " + low[found.end() :]
                break
    rest = [w for w in re.findall(r"[^\W\d_]{3,}", low) if w not in _SORTS and w not in TOWN.split() and w not in ("дом", "dom")]
    for word in rest:
        adjective = bool(_gender(word)) or any(osa(word[-4:], e, 1) <= 1 for e in ("ский", "ская", "ское"))
        if not street and adjective and not (not town and len(rest) == 1 and not _gender(word) and street):
            street = word
        elif not town:
            town = word
        elif not street:
            street = word
    if not number or not (street or town):
        return None
    house = number + "".join(f"{k}{parts[k]}" for k in "ксл" if k in parts)
    gender = _GENDER.get(sort) or _gender(street)
    return Address(code, region, town_stem(town) if town else "", sort, gender, adjective_stem(street) if street else "", house)
