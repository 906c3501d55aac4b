"""Edit distances, keyboards and letters shared by the matching operators."""

from __future__ import annotations

from functools import lru_cache

# The two keyboard layouts, key by key.
KEYS_LATIN = "`qwertyuiop[]asdfghjkl;'zxcvbnm,."
KEYS_CYRILLIC = "ёйцукенгшщзхъфывапролджэячсмитьбю"
ROWS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
# Russian letters in Latin script, as used in the documents.
TRANSLIT = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split(), strict=True)) | {"ъ": "", "ь": ""}

_TO_CYRILLIC = str.maketrans(KEYS_LATIN, KEYS_CYRILLIC)
_TO_LATIN = str.maketrans(KEYS_CYRILLIC, KEYS_LATIN)


def typed_on_latin(text: str) -> str:
    """``text`` as it comes out when typed with the Latin layout on."""
    return text.translate(_TO_LATIN)


def typed_on_cyrillic(text: str) -> str:
    return text.translate(_TO_CYRILLIC)


def transliterate(text: str) -> str:
    return "".join(TRANSLIT.get(c, c) for c in text)


@lru_cache(1)
def near_keys() -> frozenset[tuple[str, str]]:
    out = set()
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for other, at in ((row, i + 1), (ROWS[r + 1] if r < 2 else "", i), (ROWS[r + 1] if r < 2 else "", i - 1)):
                if 0 <= at < len(other):
                    out |= {(c, other[at]), (other[at], c)}
    return frozenset(out)


def weighted_dl(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance, or ``most`` + 1 where it is over ``most``.

    A swap costs 0.8, a neighbouring key 0.8, a doubled letter 0.7, a blank too many or few 0.3, any other edit 1.
    """
    if a == b:
        return 0.0
    if (abs(len(a) - len(b)) - 1) * 0.3 > most:
        return most + 1
    near = near_keys()
    before: list[float] = []
    last = [0.0]
    for j, y in enumerate(b):
        last.append(last[-1] + (0.3 if y == " " else 1.0))
    for i, x in enumerate(a):
        now = [last[0] + (0.3 if x == " " else 1.0)]
        drop = 0.3 if x == " " else 0.7 if i and a[i - 1] == x else 1.0
        for j, y in enumerate(b):
            if x == y:
                best = last[j]
            else:
                best = last[j] + (0.8 if (x, y) in near else 1.0)
                best = min(best, last[j + 1] + drop, now[j] + (0.3 if y == " " else 0.7 if j and b[j - 1] == y else 1.0))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    best = min(best, before[j - 1] + 0.8)
            now.append(best)
        if min(now) > most and (not before or min(last) > most):
            return most + 1
        before, last = last, now
    return last[-1] if last[-1] <= most else most + 1


def osa(a: str, b: str, most: int) -> int:
    """Plain distance with swaps as one edit, or ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            best = min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            now.append(best)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def deletes(word: str, most: int) -> set[str]:
    """``word`` and all it leaves after up to ``most`` deletions."""
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out
