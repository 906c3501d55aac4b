"""One form for text that looks the same (problem 2).

A transducer is compiled once from Unicode's own properties and a short list of look-alike letters. It reads
a value cluster by cluster (base character, its combining marks and the invisible characters among them),
always takes the longest known key and emits the plain form. Letters that exist in several scripts stay open
until their run ends; then the policy of the field decides which script, or digit, the run is written in.

Policies
    ``number``: letters are Cyrillic; look-alikes of digits inside or at the edge of a run of digits are digits.
    ``name``: a word keeps one script, that of its letters which have no look-alike, else that of most letters,
    else Cyrillic.

Nulls stay null. Empty texts stay empty. White space other than U+0020 becomes U+0020; nothing is trimmed.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn alike in Latin, Cyrillic and Greek; a dot means that the script has none.
LATIN = "ABCEHKMOPTXYIJSaceopxyijskËëÏïZN"
CYRILLIC = "АВСЕНКМОРТХУІЈЅасеорхуіјѕкЁёЇї.."
GREEK = "ΑΒ.ΕΗΚΜΟΡΤΧΥΙ.....ορχ.ι..κ..ΪϊΖΝ"
# Letters read as a digit inside a number.
DIGIT_LIKE = {"0": "OoОоΟο", "1": "lIІіΙι|ıӀӏ", "3": "ЗзƷʒ", "4": "Чч", "5": "SЅ", "6": "бb", "8": "BВΒ"}
# Marks whose plain drawing is another mark.
MARKS = {"„": "“", "‟": "“", "″": '"', "〝": '"', "〞": '"', "‚": ",", "⁄": "/", "∕": "/", "⧸": "/", "․": ".", "∗": "*", "⁎": "*", "−": "-", "⁃": "-", "ꞏ": ".", "‹": "«", "›": "»", "《": "«", "》": "»"}
#: Compatibility kinds that only change width or font.
WIDTHS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<circle>", "<super>", "<sub>", "<compat>")
KEPT = set("№")

PLAIN_MARKS = " \\-№«»“”\".,/()\\[\\]*"
PLAIN = {
    "number": re.compile(rf"(?:[{PLAIN_MARKS}0-9]|[а-яёА-ЯЁ]++(?![0-9])|(?<![0-9])[а-яёА-ЯЁ]++)*+"),
    "name": re.compile(rf"(?:[{PLAIN_MARKS}0-9]|[а-яёА-ЯЁ]++(?![A-Za-z])|[A-Za-z]++(?![а-яёА-ЯЁ]))*+"),
}


class Conflict(ValueError):
    """Two rules disagree about one key, or a rule's result isn't plain."""


def script(letter: str) -> str:
    code = ord(letter)
    if 0x400 <= code <= 0x52F:
        return "c"
    if 0x370 <= code <= 0x3FF or 0x1F00 <= code <= 0x1FFF:
        return "g"
    return "l" if code < 0x250 or 0x1E00 <= code <= 0x1EFF else "o"


def invisible(ch: str) -> bool:
    code = ord(ch)
    return ud.category(ch) in ("Cf", "Cn", "Cs", "Co") or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F or 0xE0100 <= code <= 0xE01EF or (ud.category(ch) == "Cc" and not ch.isspace())


@lru_cache(1)
def alike() -> dict[str, dict[str, str]]:
    """letter -> {script: its look-alike there}, each row checked to be one class."""
    out: dict[str, dict[str, str]] = {}
    for row in zip(LATIN, CYRILLIC, GREEK, strict=True):
        forms = {s: x for s, x in zip("lcg", row, strict=True) if x != "."}
        for s, x in forms.items():
            if x in out and out[x] != forms:
                raise Conflict(f"{x!r} is in two classes of look-alikes")
            if script(x) != s:
                raise Conflict(f"{x!r} isn't of the script it is listed for")
            out[x] = forms
    return out


@lru_cache(1)
def compiled() -> dict[str, str]:
    """Key (a character, or base and mark) -> plain text, over the whole of Unicode; checked for conflicts."""
    rules: dict[str, str] = {}

    def add(key: str, value: str) -> None:
        if rules.setdefault(key, value) != value:
            raise Conflict(f"{key!r}: {rules[key]!r} and {value!r}")

    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = ud.category(ch)
        if kind in ("Cn", "Cs", "Co") or ch in KEPT:
            continue
        if invisible(ch):
            add(ch, "")
        elif kind in ("Zs", "Zl", "Zp") or (kind == "Cc" and ch.isspace()):
            if ch != " ":
                add(ch, " ")
        elif ch in MARKS:
            add(ch, MARKS[ch])
        elif kind == "Pd":
            if ch != "-":
                add(ch, "-")
        elif parts := ud.decomposition(ch).split():
            if parts[0] in WIDTHS:
                flat = ud.normalize("NFKC", ch)
                add(ch, "".join("-" if ud.category(x) == "Pd" else MARKS.get(x, x) for x in flat if not ud.combining(x) or len(flat) == 1).strip() or " ")
            elif parts[0][0] != "<":
                whole = ud.normalize("NFC", ch)
                if whole != ch and len(whole) == 1:
                    add(ch, whole)
                elif whole == ch and len(parts) == 2 and kind[0] == "L":
                    add("".join(chr(int(p, 16)) for p in parts), ch)
    for key, value in list(rules.items()):
        for _ in range(3):
            value = "".join(rules.get(x, x) for x in value)
        if value and all(ud.combining(x) >= 200 for x in value):
            value = ""
        if any(x in rules for x in value):
            raise Conflict(f"{key!r} gives {value!r}, which isn't plain")
        rules[key] = value
    return rules


@lru_cache(1)
def trie() -> dict:
    """Keys as a trie; a node's result is under the empty string."""
    root: dict = {}
    for key, value in compiled().items():
        node = root
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = value
    return root


@lru_cache(1)
def digits() -> dict[str, str]:
    return {x: d for d, xs in DIGIT_LIKE.items() for x in xs}


def _plain_parts(value: str) -> str:
    """The one pass over clusters: widths, accents, spaces and invisible characters."""
    root, out, i, n = trie(), [], 0, len(value)
    while i < n:
        node, best, end, j = root.get(value[i]), None, i + 1, i
        while node is not None:
            if "" in node:
                best, end = node[""], j + 1
            j += 1
            while j < n and "" != value[j] and value[j] not in node and invisible(value[j]) and len(node) > ("" in node):
                j += 1  # an invisible character between a base and its mark
            node = node.get(value[j]) if j < n else None
        piece = value[i] if best is None else best
        if best is None and ud.combining(value[i]) >= 200:
            piece = ""  # a mark above or below that no composed letter has
        if len(piece) == 1 and end < n and ud.combining(value[end]) and (more := root.get(piece)) and value[end] in more:
            piece, end = more[value[end]][""], end + 1  # a wide base with a mark
        out.append(piece)
        i = end
    return "".join(out)


def _number_run(run: str) -> str:
    """Letters of the run as digits or in Cyrillic. Each pass is linear; it is repeated while a letter became a digit."""
    forms, digit = alike(), digits()
    n = len(run)
    while True:
        left, right = list(range(n)), list(range(n))  # ends of the stretch of look-alikes around each place
        for i in range(1, n):
            if run[i - 1] in digit:
                left[i] = left[i - 1]
        for i in range(n - 2, -1, -1):
            if run[i + 1] in digit:
                right[i] = right[i + 1]
        out = list(run)
        for i, x in enumerate(run):
            if x.isdigit() or not x.isalpha() and x != "|":
                continue
            if x in digit:
                before, after = left[i] > 0 and run[left[i] - 1].isdigit(), right[i] < n - 1 and run[right[i] + 1].isdigit()
                edge = x in "OoОоΟοlIІіΙι|ıӀӏ" and (before and right[i] == n - 1 or after and left[i] == 0)
                if before and after or edge:
                    out[i] = digit[x]
                    continue
            out[i] = forms.get(x, {}).get("c", x)
        settled = "".join(out)
        if settled == run:
            return run
        run = settled


def _name_run(run: str) -> str:
    forms = alike()
    sure = {"c": 0, "l": 0}
    seen = {"c": 0, "l": 0, "g": 0, "o": 0}
    for x in run:
        s = script(x)
        seen[s] += 1
        if s in sure and ("c" if s == "l" else "l") not in forms.get(x, {}):
            sure[s] += 1
    if sum(1 for v in seen.values() if v) == 1 and not seen["g"]:
        return run
    target = max("cl", key=lambda s: (sure[s], seen[s]))
    return "".join(x if script(x) == target else forms.get(x, {}).get(target, x) for x in run)


_RUN = {"number": re.compile(r"[^\W_]+|[^\W_]*\|[^\W_]*"), "name": re.compile(r"[^\W\d_]+")}


def unify(value: str | None, policy: str) -> str | None:
    """The one form in which ``value`` is read; see the module for the policies."""
    if value is None or PLAIN[policy].fullmatch(value):
        return value
    flat = _plain_parts(value)
    settle = _number_run if policy == "number" else _name_run
    return _RUN[policy].sub(lambda m: settle(m[0]), flat)


@F.pandas_udf(T.StringType())
def _unify_number(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unify(x, "number"))


@F.pandas_udf(T.StringType())
def _unify_name(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unify(x, "name"))


def unified(col: Column | str, policy: str = "name") -> Column:
    """Column form of :func:`unify`; one Arrow pass over each batch."""
    return {"number": _unify_number, "name": _unify_name}[policy](col)


def unify_fields(df: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(field_path, key, value, unified) for every non-null value of ``fields`` {field_path: (column, policy)}.

    The table is read once; each policy is one Arrow stage. Rows with equal keys are all kept.
    """
    parts = [F.struct(F.lit(p).alias("field_path"), F.lit(pol).alias("policy"), F.col(c).alias("value")) for p, (c, pol) in fields.items()]
    long = df.select(F.col(key), F.inline(F.array(*parts))).where(F.col("value").isNotNull())
    return long.select("field_path", key, "value", _unify_any("value", "policy").alias("unified"))


@F.pandas_udf(T.StringType())
def _unify_any(values: pd.Series, policies: pd.Series) -> pd.Series:
    return pd.Series([unify(x, p) for x, p in zip(values, policies, strict=True)], dtype=object)
