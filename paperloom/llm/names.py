"""Names of people, firms, authorities and courts, read into comparable parts.

A name is read as a kind (p: person, o: organisation, t: tax office, c: court), a block that must be equal (numbers,
sort of court), a core that may hold typing errors (surname, firm, place), and two slots that may be missing or cut
(first name and patronymic; legal form; region). All parts are in one alphabet, in which Russian letters and
their Latin spelling meet. Posts, remarks and words for a branch are no part.
"""

from __future__ import annotations

import re
import unicodedata as ud
from dataclasses import dataclass
from functools import lru_cache
from itertools import permutations

from paperloom.llm import people
from paperloom.llm.edit import deletes, near_keys, osa
from paperloom.llm.glyphs import unify

_CYRILLIC = str.maketrans("ёэйъь", "ееы\x00\x00")
# Latin spelling of Russian sounds, longest first.
_LATIN = [("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я")]
_SINGLE = str.maketrans("abvgdeziklmnoprstufyhjcwqx", "абвгдезиклмнопрстуфыхжквкк")


def fold(word: str) -> str:
    """``word`` in the common alphabet: lower case, ё э as е, й as ы, without signs; Latin by sound."""
    word = word.lower()
    if re.search("[a-z]", word):
        word = "".join(c for c in ud.normalize("NFD", word) if not ud.combining(c))
        for latin, letter in _LATIN:
            word = word.replace(latin, letter)
        word = word.translate(_SINGLE)
    return word.translate(_CYRILLIC).replace("\x00", "").replace("тс", "ц")


@lru_cache(1)
def folded_near() -> frozenset[tuple[str, str]]:
    return frozenset((fold(a), fold(b)) for a, b in near_keys())


@lru_cache(200_000)
def typo_cost(noisy: str, clean: str) -> int:
    """Slips that make ``clean`` into ``noisy``: a swap, a lost or doubled letter, a neighbouring key; 9 where others are needed.

    Only the band of two letters beside the diagonal is looked at, so long words cost in proportion to their length.
    """
    if noisy == clean:
        return 0
    n, m = len(clean), len(noisy)
    if abs(m - n) > 2:
        return 9
    near = folded_near()
    before: dict[int, int] = {}
    last = {j: 9 * j for j in range(min(m, 2) + 1)}
    for i in range(1, n + 1):
        x, now = clean[i - 1], {}
        for j in range(max(0, i - 2), min(m, i + 2) + 1):
            best = last.get(j, 9) + 1  # a lost letter
            if j:
                y = noisy[j - 1]
                if x == y:
                    best = min(best, last.get(j - 1, 9))
                else:
                    best = min(best, last.get(j - 1, 9) + (1 if (x, y) in near else 9))
                    if i > 1 and j > 1 and x == noisy[j - 2] and y == clean[i - 2]:
                        best = min(best, before.get(j - 2, 9) + 1)
                doubled = j > 1 and noisy[j - 2] == y
                best = min(best, now.get(j - 1, 9) + (1 if doubled or (i == n and j == m and y in "ск") else 9))
            now[j] = best
        if min(now.values()) > 2 and min(last.values()) > 2:
            return 9
        before, last = last, now
    return min(last.get(m, 9), 9)


@lru_cache(1)
def first_names() -> dict[str, frozenset[str]]:
    """Folded spelling (also genitive and short) -> the names that it may stand for, as name, + for a genitive."""
    out: dict[str, set[str]] = {}
    for sex, rows in (("m", people.MEN), ("f", people.WOMEN)):
        for row in rows.replace("\n", " ").split(";"):
            name, *short = row.split()
            if sex == "m":
                short = short[1:]
            full = fold(name)
            out.setdefault(full, set()).add(full)
            for s in short:
                out.setdefault(fold(s), set()).add(full)
            for g in _genitives(name, sex):
                out.setdefault(fold(g), set()).add(full + "+")
    return {k: frozenset(v) for k, v in out.items()}


def _genitives(name: str, sex: str) -> list[str]:
    if name == "Пётр":
        return ["Петра"]
    if name == "Павел":
        return ["Павла"]
    if name.endswith(("й", "ь")):
        return [name[:-1] + ("я" if sex == "m" else "и")]
    if name.endswith("я"):
        return [name[:-1] + "и"]
    if name.endswith("а"):
        return [name[:-1] + ("и" if name[-2] in "гкхжшщч" else "ы")]
    return [name + "а"]


@lru_cache(1)
def patronymics() -> dict[str, str]:
    """Folded patronymic, also in the genitive (+) -> its nominative."""
    out = {}
    for row in people.MEN.replace("\n", " ").split(";"):
        stem = row.split()[1]
        for man, woman in ((stem + "ич", stem + "на"),) if stem != "Ильи" else (("Ильич", "Ильинична"),):
            out[fold(man)], out[fold(woman)] = fold(man), fold(woman)
            out.setdefault(fold(man + "а"), fold(man) + "+")
            out.setdefault(fold(woman[:-1] + "ы"), fold(woman) + "+")
    return out


class Known:
    """Words with the slips of others told by symmetric deletes."""

    def __init__(self, words: dict, most: int):
        self.words, self.longest = words, max(map(len, words)) + most
        self.left: dict[str, list[str]] = {}
        for w in words:
            for d in deletes(w, most):
                self.left.setdefault(d, []).append(w)

    def nearest(self, word: str, most: int) -> list:
        """What the words say that are nearest to ``word``, ``most`` slips away at most."""
        if word in self.words:
            return [self.words[word]]
        if not 3 <= len(word) <= self.longest:
            return []
        found: dict[int, set[str]] = {}
        for k in {k for d in deletes(word, most) for k in self.left.get(d, ())}:
            if (d := osa(word, k, most)) <= most:
                found.setdefault(d, set()).add(k)
        return [self.words[k] for k in sorted(found[min(found)])] if found else []


@lru_cache(1)
def _known_firsts() -> Known:
    return Known(first_names(), 2)


@lru_cache(1)
def _known_patronymics() -> Known:
    return Known(patronymics(), 2)


@lru_cache(50_000)
def first_of(word: str) -> frozenset[str]:
    """First names (+ for a genitive) that the folded word may be."""
    found = _known_firsts().nearest(word, 1 if len(word) < 8 else 2)
    return frozenset().union(*found) if found else frozenset()


@lru_cache(50_000)
def patronymic_of(word: str) -> str:
    found = _known_patronymics().nearest(word, 2)
    return found[0] if found else ""


# Endings of folded patronymics, nominative and genitive.
_PATRONYMIC = re.compile("(?:(?:ов|ев)ич|(?:ов|ев|ич)на|((?:ов|ев)ича|(?:ов|ев|ич)ны))$")


def patronymic_like(word: str) -> str:
    """The nominative (+ for a genitive) of a folded word that only its ending shows to be a patronymic."""
    found = _PATRONYMIC.search(word)
    if not found or len(word) < 6:
        return ""
    return word if not found[1] else (word[:-1] if word.endswith("ича") else word[:-1] + "а") + "+"


def _nominative(first: str, woman: bool) -> str:
    """The nominative of a folded first name in the genitive that no list has."""
    if woman:
        return first[:-1] + ("а" if first.endswith("ы") else "я") if first.endswith(("ы", "и")) else first
    return first[:-1] + ("ы" if first.endswith("я") else "") if first.endswith(("а", "я")) else first


@dataclass(frozen=True)
class Name:
    kind: str
    block: str
    cores: tuple[str, ...]
    slot1: str = ""
    slot2: str = ""
    full: bool = False


#: Starts a core whose words are in alphabetical order.
SORTED = "\x02"
_TOKEN = re.compile(r"[^\W\d_]+\.?|\d+")
_GLUED = re.compile(r"(?<=[а-яёa-z])(?=[А-ЯЁA-Z]\.)")


def surname_forms(word: str, genitive: bool | None) -> list[str]:
    """Nominatives that a folded surname may stand for, the likeliest first; ``genitive`` None where unknown."""
    other = []
    if word.endswith("ого"):
        other = [word[:-3] + "иы"]
    elif word.endswith("скоы"):
        other = [word[:-2] + "ая"]
    elif word.endswith("оы"):
        other = [word[:-2] + "а"]
    elif word.endswith("а"):
        other = [word[:-1]]
    if genitive is None:
        return [word, *other]
    return other or [word] if genitive else [word]


def person(text: str) -> Name | None:
    """A person's name; None where it can't be one."""
    text = _GLUED.sub(" ", re.sub(r"\([^)]*\)?", " ", text))
    comma = re.match(r"\s*([^\W\d_]{3,})\s*,", text)
    tokens = [t for t in _TOKEN.findall(text) if t.rstrip(".").lower() not in people.POSTS]
    if not 2 <= len(tokens) <= 3 or any(t.isdigit() for t in tokens):
        return None
    short = [t.endswith(".") and len(t) <= 5 for t in tokens]
    if all(short) or len([1 for t, s in zip(tokens, short, strict=True) if not s and len(t.rstrip(".")) == 1]) > 0:
        return None
    words = [fold(t.rstrip(".")) for t in tokens]
    full = [w for w, s in zip(words, short, strict=True) if not s]
    cut = [w + "." for w, s in zip(words, short, strict=True) if s]
    first = patronymic = ""
    if len(words) == 3 and not cut:
        as_sfp, as_fps = (2 * bool(first_of(f)) + max(2 * bool(patronymic_of(p)), bool(patronymic_like(p))) + (f in first_names()) for f, p in (words[1:], words[:2]))
        if not as_sfp and not as_fps:
            return None
        surname, first, patronymic = words if as_sfp >= as_fps or comma else (words[2], words[0], words[1])
    elif len(words) == 2 and not cut:
        a, b = words
        at0, at1 = bool(first_of(a)) + (a in first_names()), bool(first_of(b)) + (b in first_names())
        if not at0 and not at1:
            return None
        surname, first = (b, a) if at0 > at1 and not comma else (a, b)
    elif len(full) == 1:
        surname, first, patronymic = full[0], cut[0], cut[1] if len(cut) > 1 else ""
    elif len(full) == 2 and len(cut) == 1:
        surname, first, patronymic = full[0], full[1], cut[0]
        if first_of(full[0]) and not first_of(full[1]):
            surname, first = full[1], full[0]
    else:
        return None
    genitive: bool | None = None if first.endswith(".") else False
    if patronymic and not patronymic.endswith("."):
        known = patronymic_of(patronymic) or patronymic_like(patronymic) or patronymic
        genitive, patronymic = known.endswith("+"), known.rstrip("+")
    if first and not first.endswith("."):
        names = first_of(first)
        if patronymic and not patronymic.endswith("."):
            woman = patronymic.endswith("на")
            fit = {n for n in names if n.endswith("+") == genitive and n.rstrip("+").endswith(("а", "я")) == woman or n.rstrip("+") in ("иля", "никита") and not woman}
            names = fit or {n for n in names if n.rstrip("+").endswith(("а", "я")) == woman} or names
        else:
            genitive = None if len({n.endswith("+") for n in names}) > 1 else bool(names) and next(iter(names)).endswith("+")
        if not names and genitive:
            first = _nominative(first, patronymic.endswith("на"))
        first = "|".join(sorted({n.rstrip("+") for n in names})) or first
    whole = bool(first and patronymic) and not (first.endswith(".") or patronymic.endswith(".") or "|" in first)
    return Name("p", "", tuple(surname_forms(surname, genitive)), first, patronymic, whole)


@lru_cache(1)
def _known_forms() -> Known:
    return Known({w: (at, key) for at, (key, ways) in reversed(list(enumerate(people.FORM_WORDS.items()))) for w in ways.split()}, 2)


@lru_cache(50_000)
def _form_word(word: str) -> str:
    known = _known_forms()
    if word in known.words:
        return known.words[word][1]
    if not 4 < len(word) <= known.longest:
        return ""
    near = {w for d in deletes(word, 2) for w in known.left.get(d, ()) if osa(word, w, 2) <= (2 if len(w) > 7 else 1)}
    return min(known.words[w] for w in near)[1] if near else ""


_SHORT_FORMS = {x: k for k, xs in people.FORMS.items() for x in xs.split()}
_SECOND = [fold(x) for x in people.SECOND.split()]


def organisation(text: str) -> Name:
    low = re.sub(r"\bs\.\s*r\.\s*o\b\.*", "sro", text.lower())
    low = re.sub(r"\([^)]*(?:инн|указан|предст|дов)[^)]*\)?|\bдоп\.? офис\b|\bс (?=огранич)", " ", low)
    form, bank, rest, words = "", False, [], set()
    for token in re.findall(r"[^\W_]+\.?", low):
        word = token.rstrip(".")
        if word in _SHORT_FORMS and not form:
            form = _SHORT_FORMS[word]
        elif word in ("банк", "акб", "bank", "банка", "банком"):
            bank = True
        elif word in people.POSTS or word in ("с", "и") and words:
            continue
        elif known := _form_word(word):
            words.add(known)
        else:
            folded = fold(word)
            if token.endswith(".") and rest and len(folded) > 2:
                folded = next((s for s in _SECOND if s.startswith(folded)), folded)
            rest.append(folded)
    if words and not form:
        form = min(people.LONG_FORMS, key=lambda k: len(words ^ {w for w in people.LONG_FORMS[k].split() if w != "с"}))
    if len(rest) > 1 and len(rest[-1]) == 3:
        rest[-1] = next((s for s in _SECOND if s.startswith(rest[-1])), rest[-1])
    tail = "банк" if bank and not "".join(rest).endswith("банк") else ""
    return Name("o", "", tuple(x + tail for x in orders(rest)), form, "", bool(form))


#: Words up to which all orders of an organisation's words are looked up.
ORDERED = 4


def orders(words: list[str]) -> list[str]:
    """Ways in which the words may follow each other, as written first.

    Up to ``ORDERED`` words in every order. More words also in alphabetical order, marked, as no order of others is alike.
    """
    written = "".join(words)
    if len(words) > ORDERED:
        return [written, SORTED + "".join(sorted(words))]
    return list(dict.fromkeys([written, *map("".join, permutations(words))]))


_REGION = re.compile(r"(?<![^\W\d_])([^\W\d_]+)\s+(область|области|обл|oblast|oblasti|obl|kr|края|край|краю|кр|krai|kray|kraya)\b\.?|(?:республик\w|респ|respublik\w|resp)\b\.?\s+([^\W\d_]+)")


# Endings of places' adjectives and names; those of the first pattern may be mistyped.
_SURE = re.compile("(?:ского|ским|скому|ском|ской|ская|ский|ски[йи]|ское|skogo|skim|skomu|skom|skoy|skaya|skiy|skoe)$")
_OTHER = re.compile("(?:ск|sk|[оеё]й|ая|ого|ому|aya|oy|ogo|omu)$")
_MISTYPED = ("ская", "ский", "ское", "ского", "ским", "ской", "skaya", "skiy", "skoe", "skogo")
# Fixed value: the first letter of an ending, swapped with the stem's last one.
_SWAPPED = re.compile("(?:с([^\\W\\d_])к(?:ая|ий|ое|ого|им|ой|ом|ому)|s([^\\W\\d_])k(?:aya|iy|oe|ogo|im|oy|om|omu))$")


def adjective_stem(word: str) -> str:
    """The folded stem of a place's name or adjective, also where its ending is mistyped."""
    stem, n = _SURE.subn("", word)
    if n:
        return fold(stem)
    if swapped := _SWAPPED.search(word):
        return fold(word[: swapped.start()] + (swapped[1] or swapped[2]))
    slip = {b for a, b in near_keys() if a == "с"} | {"с", "s"}
    for more in (0, 1, -1):
        for end in _MISTYPED:
            tail = word[-len(end) - more :]
            if len(word) < len(tail) + 3 or osa(tail, end, 1) > 1:
                continue
            if more == 0 and (tail[0] in slip or tail[1] == end[0]) or more > 0 and len(set(tail)) < len(tail) or more < 0:
                return fold(word[: -len(tail)])
    return fold(_OTHER.sub("", word))


def region_of(low: str) -> tuple[str, str]:
    """(region's stem, the text without it)."""
    found = _REGION.search(low)
    if not found:
        return "", low
    if found[3]:
        return "r" + re.sub("(?:ья|ье|ю|я|е)$", "", fold(found[3])), low[: found.start()] + " " + low[found.end() :]
    return fold(found[2])[0] + adjective_stem(found[1]), low[: found.start()] + " " + low[found.end() :]


_COURT_WORDS = tuple(map(fold, "судебный судебного суд судом суда участок участка участке мирового мировой мировым судьи судья судьёй уч мир района район она город города но рай гор sudebnyy sud uchastok rayona gorod no".split()))


def court(text: str) -> Name:
    low = re.sub(r"\s+", " ", text.lower())
    region, low = region_of(low)
    number = "".join(re.findall(r"\d+", low))
    written = re.findall(r"[^\W\d_]+", low)
    words = [fold(w) for w in written]
    sort = ""
    if number or any(w.startswith(("мирово", "участ", "учас")) or w == "мир" for w in words):
        sort = "m"
    rest = []
    for w, original in zip(words, written, strict=True):
        if sort != "m" and not (sort and len(w) < 5):
            if w in ("раыонныы", "раыонным", "раыонного", "раыонном", "раысуд", "раы") or (len(w) > 5 and osa(w, "раыонныы", 2) <= 2) or osa(w, "раысуд", 1) <= 1:
                sort = "r"
                continue
            if w in ("городскоы", "городским", "городского", "горсуд", "гор") or (len(w) > 6 and osa(w, "городскоы", 2) <= 2) or osa(w, "горсуд", 1) <= 1:
                sort = "g"
                continue
        if w in _COURT_WORDS or len(w) < 3 or len(w) > 4 and any(osa(w, x, 1) <= 1 for x in _COURT_WORDS if len(x) > 4):
            continue
        rest.append(original)
    if not sort:
        sort = "r" if re.search(r"\bр/с\b", low) else "g" if re.search(r"\bг/с\b", low) else "?"
    place = max(rest, key=len, default="")
    return Name("c", f"{sort}{number}", (adjective_stem(place),), region, "", bool(region))


def tax_office(text: str) -> Name:
    low = re.sub(r"[«»\"“”()]", " ", text.lower())
    region, low = region_of(low)
    return Name("t", "".join(re.findall(r"\d+", low)), (region,), "", "", True)


_TAX = re.compile(r"\b(?:м?ифнс|фнс|мри|налогов\w+|ifns|fns|mifns|mri)\b", re.I)
_STAND_IN = re.compile(r"^\W*$|^\s*\[.*\]\s*$|^\s*гражданин\w*\s+[a-zа-я]\.?\s*$", re.I)


def read(value: str | None, kinds: str) -> Name | None:
    """``value`` as one of ``kinds``; None for blanks and stand-ins."""
    text = re.sub(r"\s+", " ", unify(value, "name") or "").strip()
    if _STAND_IN.search(text):
        return None
    if kinds == "c":
        found = court(text)
    elif _TAX.search(text) and "t" in kinds:
        found = tax_office(text)
    else:
        found = None
        if "p" in kinds and ("o" not in kinds or not re.search(r"[«»\"“”]|\b(?:ltd|gmbh|ag|sro|s\.r\.o)\b", text.lower())):
            tokens = {t.lower() for t in re.findall(r"[^\W\d_]+", text)}
            if "o" not in kinds or not tokens & (set(_SHORT_FORMS) | {"фирма", "firma", "банк", "bank", "акб"}) and not any(_form_word(t) for t in tokens if len(t) > 6):
                found = person(text)
        if found is None and "o" in kinds:
            found = organisation(text)
    if found is None or not found.cores[0]:
        return Name("x", "", (re.sub(r"\W", "", text.lower()),), "", "", True) if text else None
    return found


def plain(value: str) -> str:
    """Spelling by which variants of a name are counted."""
    return re.sub(r"\s+", " ", unify(value, "name") or "").strip().lower()


def slot_cost(mine: str, other: str, kind: str) -> float:
    """What it costs that slot ``mine`` stands for ``other``; 9 where it can't."""
    if mine == other:
        return 0.0
    if not mine:
        return 0.3
    if not other:
        return 0.6
    if mine.endswith("."):
        start = mine[:-1]
        return 0.1 if any(x.startswith(start) for x in other.rstrip(".").split("|")) else 9.0
    if other.endswith("."):
        return 0.5 if any(x.startswith(other[:-1]) for x in mine.split("|")) else 9.0
    if "|" in mine or "|" in other:
        return 0.1 if set(mine.split("|")) & set(other.split("|")) else 9.0
    if kind == "o":
        return 9.0
    if len(mine) > 4 and len(other) > 4:
        cost = typo_cost(mine, other)
        return float(cost) if cost <= 2 else 9.0
    return 9.0
