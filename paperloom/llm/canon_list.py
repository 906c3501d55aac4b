"""Freely typed values mapped to a reference list (problem 1).

Words of the list's entries go into a symmetric-delete dictionary: each word under all that is left of it after a few
deletions, and so are its beginnings, as clerks cut words short. A value's words look up the entries that share a
word within the bounded distance; these are ranked in two steps.

1. Whole phrases: weighted Damerau-Levenshtein distance over the phrase, words in any order at a small cost.
2. Word by word, where no phrase is near: each word of the value stands for an entry's word that it is within the bounded
   distance of, or cut from (исп.), drawn together from (р-н, и/лист, райсуд), derived like, or for several words by their initials
   (КСОЮ). Words weigh by how few entries of the field have them, so that what all entries share may be missing and
   what none has speaks against the entry. The fit is the harmonic mean of both shares, and must reach ``FIT``.

Of equal rank the entry that itself occurs more often wins, then the smaller id. What fits nothing is a miss and has
entry 0. Other names of entries and phrases known to be outside the list can't be told by spelling; they are
optional arguments, and are matched as phrases are.

Each distinct value is matched once. A list of up to ``BLOCK`` entries is broadcast; a longer one is cut into parts by a hash
and meets the values part by part in tasks of bounded size, nothing of it on the driver. Null and blank values have no entry
(null). Repeated rows keep their rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import lexicon
from paperloom.llm.edit import deletes, transliterate, typed_on_cyrillic, typed_on_latin, weighted_dl
from paperloom.llm.glyphs import unify
from paperloom.session import durable

#: Entries of the list that go into one dictionary.
BLOCK = 20_000
#: Distance that a phrase may have for each of its letters, and the least length for an edit.
SHARE, LEAST = 0.25, 4
#: The least fit of a value's words to an entry's, and what the second step adds to a distance.
FIT, SECOND = 0.55, 100.0
#: Distinct values that one task matches against one part of a long list, and that are broadcast with what they mean.
VALUES, MAPPED = 50_000, 200_000
REMEMBERED = 200_000
#: Letters that tell whether an entry holds a word, and how many entries of a field a word must be in one of to count as less than rare.
STEM, RARE = 5, 100
MISS = 0
# Words that tell nothing, in both scripts.
CONNECTING = frozenset("и или а в во на по о об от до для с со из к ко при за i ili v vo na po ob ot do dlya s so iz k ko pri za".split())

_FOLD = str.maketrans("ёйЁЙ", "еиеи")


def words_of(text: str) -> list[str]:
    """Words, lower case, without ё and й; an abbreviation's strokes are dropped (и/лист is илист)."""
    text = re.sub(r"\b(\w{1,2})/(\w+)", r"\1\2", text.lower())
    text = re.sub(r"(?<=\w)-(?=(?:н|на|ка|в|во|ра|ва|ие)\b)", "", text)
    return re.findall(r"[^\W_]+", text.translate(_FOLD))


def _remarks(words: Iterable[str]) -> frozenset[str]:
    words = list(words)
    short = {d for w in words for n in range(4, len(w)) for d in deletes(w[:n], int(n > 5))}
    return frozenset(short | {d for w in words for d in deletes(w, 2 if len(w) > 5 else 1) if len(d) > 2})


_TAILS = {False: _remarks(lexicon.AFTER), True: _remarks([*map(transliterate, lexicon.AFTER), *map(typed_on_latin, lexicon.AFTER)])}
_LONGEST_TAIL = max(len(w) for ws in _TAILS.values() for w in ws) + 2
_NUMBERED = re.compile(r"[\s,;(/-]*\b(?:см|sm|cv)\.? (?:прил|pril|ghbk)\.?\s*\d*\W*$|[\s,;(/-]*\b(?:от|ot|jn) \d[\d.]*\W*$|\s*(?:№|no\.?)\s*\d+\W*$|\s*\(\d+ (?:экз|ekz|'rp)\.?\W*$|[\s,(]*\b(?:б/н|b/n|,/y)\W*$|\s+(?:тип|н|вид)\.?:$")
_LEADS = re.compile(rf"^\W*(?:\d+\)\s*|(?:{'|'.join([*lexicon.BEFORE, *map(transliterate, lexicon.BEFORE), *map(typed_on_latin, lexicon.BEFORE)])})(?:\.?:|\s*[-–—]\s)\s*)")


def trimmed(text: str) -> str:
    """``text`` in lower case without the remarks around it, however many there are."""
    text = re.sub(r"[\s_]+", " ", text).strip().lower()
    while True:
        less = _LEADS.sub("", _NUMBERED.sub("", text), count=1)
        tail = re.search(r"(?:[\s]*[-–—,(\[/«\"]+\s*)([^\W\d_](?:[^\W\d_]|,(?=[^\W\d_]))+)\W*$", less)
        if tail and tail.start() and len(tail[1]) <= _LONGEST_TAIL and not _TAILS[tail[1].isascii()].isdisjoint(deletes(tail[1], 2 if len(tail[1]) > 5 else 1)):
            less = less[: tail.start()]
        head = re.match(r"[(\[/]([^\W\d_]{3,})[)\]/]\s*(?=\w)", less)
        if head and len(head[1]) <= _LONGEST_TAIL and not _TAILS[head[1].isascii()].isdisjoint(deletes(head[1], 1)):
            less = less[head.end() :]
        less = re.sub(r"^(?:б/н|№\s*\d+)\s+|\s+(?:дубл|ориг|копи)[а-я]*\.$", "", less)
        first, _, rest = less.partition(" ")
        if rest.endswith(",") and 2 < len(first) <= _LONGEST_TAIL and not _TAILS[first.isascii()].isdisjoint(deletes(first, 2)):
            less = rest[:-1]  # the remark stands before: "дубликат ИЛ,"
        if less == text:
            return text
        text = less.strip()


def forms(value: str) -> list[list[str]]:
    """The value's words: as they stand; Latin letters also as typed with the wrong layout on."""
    text = trimmed(unify(value, "name") or "")
    out = [[w for w in words_of(text) if not w.isdigit()]]
    if re.search("[a-z]", text):
        text = re.sub(r"\.{2,}$", "", text)
        while text[:1] + text[-1:] in ("[]", '""', "«»", "()"):
            text = text[1:-1]
        out.append([w for w in words_of(trimmed(typed_on_cyrillic(text))) if not w.isdigit()])
    return [x for x in out if x]


def cut_forms(value: str) -> list[tuple[list[str], set[str]]]:
    """The value's words with dashes inside kept, and those that a dot or stroke shows to be cut; read in both layouts."""
    text = trimmed(unify(value, "name") or "")
    out = []
    for way in [text, trimmed(typed_on_cyrillic(text))] if re.search("[a-z]", text) else [text]:
        found = re.findall(r"(?<![^\W_])([^\W\d_]+(?:-[^\W\d_]{1,3})?)(?![^\W_])([./]?)", way.translate(_FOLD))
        cut = {w for w, sign in found if sign} | {b for (_, sign), (b, _) in pairwise(found) if sign == "/" and len(b) < 3}
        words = [w for w, _ in found]
        for own in (words, [x for w in words for x in w.split("-")]) if any("-" in w for w in words) else (words,):
            out.append((own, cut | {w for w in own if len(w) < 3}))
    return [x for x in out if x[0]]


def allowed(word: str) -> int:
    return 0 if len(word) < LEAST else 1 if len(word) < 6 else 2


def stems_of(canonical: str) -> set[str]:
    """Beginnings of an entry's words, in both scripts."""
    return {w[:STEM] for w in (*words_of(canonical), *words_of(transliterate(canonical.lower())))}


def initials(words: list[str]) -> dict[str, list[tuple[int, ...]]]:
    """The first letters of two and more words in a row, with or without those of one or two letters, and where these stand."""
    out: dict[str, list[tuple[int, ...]]] = defaultdict(list)
    for places in ([i for i, w in enumerate(words) if len(w) > 2], list(range(len(words)))):
        for i in range(len(places)):
            for j in range(i + 2, len(places) + 1):
                run = tuple(places[i:j])
                if run not in out[key := "".join(words[k][0] for k in run)]:
                    out[key].append(run)
    return out


@lru_cache(REMEMBERED)
def likeness(word: str, other: str, dotted: bool) -> float:
    """How well ``word`` stands for ``other``, from 0 to 1."""
    if word == other:
        return 1.0
    head, dash, tail = word.partition("-")
    if dash:
        return 0.9 if tail and other.startswith(head) and other.endswith(tail) and len(other) >= len(head) + len(tail) else 0.0
    n = len(word)
    if other.startswith(word):
        return 0.9 if n > 3 else 0.85 if n == 3 else 0.7 if n == 2 and dotted else 0.5 if dotted else 0.0
    most = allowed(min(word, other, key=len))
    if most and (cost := weighted_dl(word, other, most)) <= most:
        return 1 - cost / len(other)
    if n > 3 and n < len(other) and (cost := weighted_dl(word, other[:n], 1.0)) <= 1:
        return 0.9 - cost / n
    same = 0
    while same < min(n, len(other)) and word[same] == other[same]:
        same += 1
    if same > 4 and same * 2 > len(other) and n - same < 7:
        return 0.8
    k = min(n, len(other)) - 3
    if k > 4 and max(n, len(other)) < k + 7:  # derived alike, and with a slip
        return 0.7 if min(weighted_dl(word[: k + j], other[:k], 1.0) for j in (0, 1, -1)) <= 1 else 0.0
    return 0.0


def glued(word: str, words: list[str]) -> tuple[int, ...] | None:
    """Places of two or more of ``words``, in order, whose beginnings of three letters or more make up ``word``."""
    def fill(at: int, after: int) -> tuple[int, ...] | None:
        if at == len(word):
            return ()
        for i in range(after, len(words)):
            same = 0
            while same < len(words[i]) and at + same < len(word) and words[i][same] == word[at + same]:
                same += 1
            for n in range(same, 2, -1):
                if (rest := fill(at + n, i + 1)) is not None:
                    return (i, *rest)
        return None

    found = fill(0, 0) if 6 <= len(word) <= 60 else None
    return found if found and len(found) > 1 else None


class Matcher:
    """The compiled dictionary of one block of entries; see the module.

    ``aliases`` {field: {entry: "name; name"}} and ``outside`` {field: "phrase; phrase"} are optional. ``share`` bounds a
    phrase's distance; it may be wider where ``outside`` has what lies near the entries. ``size`` and ``holders`` are the
    entries of each field and those that hold a stem, where the block is a part of the list.
    """

    def __init__(self, entries: Iterable[tuple[int, str, str]], counts: dict[int, int], aliases: dict | None = None, outside: dict | None = None, share: float = SHARE, size: dict | None = None, holders: dict | None = None):
        self.counts, self.share = counts, share
        self.longest = 0
        self.known: dict[tuple[str, ...], tuple[float, int, int]] = {}
        self.letters: dict[str, list[Counter[str]]] = defaultdict(list)
        self.starts: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.phrases: dict[str, list[tuple[list[str], str, int]]] = defaultdict(list)
        self.exact: dict[tuple[str, str], int] = {}
        self.index: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.words: set[tuple[str, str]] = set()
        self.short: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.entry: dict[str, dict[int, dict[str, list[tuple[int, ...]]]]] = defaultdict(dict)
        self.holders: dict[tuple[str, str], int] = holders or {}
        self.size: dict[str, int] = size or {}
        fields = defaultdict(list)
        for ref, field, canonical in entries:
            fields[field].append((ref, canonical))
        if size is None:
            self.size = {f: len(refs) for f, refs in fields.items()}
            self.holders = Counter((f, w) for f, refs in fields.items() for _, canonical in refs for w in stems_of(canonical))
        for field, refs in fields.items():
            known = (aliases or {}).get(field, {})
            for ref, canonical in refs:
                self._add(field, [canonical], ref, True)
                self._add(field, known.get(canonical, "").split("; "), ref)
            self._add(field, (outside or {}).get(field, "").split("; "), MISS)

    def _add(self, field: str, texts: list[str], ref: int, own: bool = False) -> None:
        for text in filter(None, texts):
            for way in (str, transliterate):
                words = words_of(way(text.lower()))
                key = " ".join(words)
                if self.exact.setdefault((field, key), ref) != ref:
                    continue
                self.exact.setdefault((field, " ".join(sorted(words))), ref)
                self.exact.setdefault((field, "".join(words)), ref)
                at = len(self.phrases[field])
                self.phrases[field].append((words, key, ref))
                self.letters[field].append(Counter("".join(words)))
                if own:
                    self.words |= {(field, w) for w in words}
                    for i, j in combinations(range(len(words)) if len(words) < 6 else (), 2):
                        for n in range(3, min(6, len(words[i]))):  # drawn together, where a slip may be besides
                            self._add(field, [words[i][:n] + words[j]], ref)
                    runs = initials(words_of(text))
                    self.entry[field][at] = {way(letters): places for letters, places in runs.items()} if len(words) == len(words_of(text)) else initials(words)
                    for letters in self.entry[field][at]:
                        self.short[field, letters].add(at)
                for w in {*words, "".join(words)}:
                    self.longest = max(self.longest, len(w))
                    for d in deletes(w, allowed(w)):
                        self.index[field, d].add(at)
                    for n in range(1 if own else 3, len(w)):
                        for d in deletes(w[:n], int(n > 4)):
                            self.starts[field, d].add(at)

    def weight(self, field: str, word: str) -> float:
        """What a word tells: more, the fewer entries of the field have it."""
        if word in CONNECTING:
            return 0.1
        held = self.holders.get((field, word[:STEM]), 0)
        return min(math.log(RARE), max(0.1, math.log((self.size[field] + 1) / max(1, held))))

    def fit(self, field: str, words: list[str], dotted: set[str], at: int) -> float:
        """How well the value's words and the entry's stand for each other, from 0 to 1."""
        other = self.phrases[field][at][0]
        short = self.entry[field][at]
        left = set(range(len(other)))
        weights = [self.weight(field, w) for w in other]
        got = held = told = 0.0
        for w in sorted(words, key=len, reverse=True):
            best, places = 0.0, ()
            for run in short.get(w, ()):
                if left.issuperset(run):
                    best, places = 0.85, run
                    break
            if not best and (run := glued(w, other)) and left.issuperset(run):
                best, places = 0.9, run
            whole = w not in dotted and (field, w) in self.words
            for i in sorted(left):
                if whole and other[i] != w and other[i].startswith(w):
                    continue  # an entry's own word is no other word cut short
                if (q := likeness(w, other[i], w in dotted)) > best:
                    best, places = q, (i,)
            if places:
                left -= set(places)
                got += best * sum(weights[i] for i in places)
                held += sum(weights[i] for i in places)
                told += sum(weights[i] for i in places)
            else:
                told += self.weight(field, w) if len(w) > 2 else 0.2
        share, kept = got / (sum(weights) or 1), held / (told or 1)
        return 2 * share * kept / (share + kept) if got else 0.0

    def _fitting(self, field: str, words: list[str], dotted: set[str]) -> tuple[float, int, int]:
        ats: set[int] = set()
        for w in words:
            if len(w) > self.longest + 2:
                continue
            for d in {*deletes(w, allowed(w)), *(w[:n] for n in range(3, 6)), *(w[i:] for i in range(3, len(w) - 4)), *([w.partition("-")[0]] if "-" in w else [])}:
                ats |= self.index.get((field, d), set()) | (self.starts.get((field, d), set()) if len(d) > 2 or w in dotted or "-" in w else set())
            ats |= self.short.get((field, w), set())
            if w in dotted:
                ats |= self.starts.get((field, w), set())
        found = (float("inf"), 0, MISS)
        for at in ats & self.entry[field].keys():
            ref = self.phrases[field][at][2]
            if (fit := round(self.fit(field, words, dotted, at), 2)) >= FIT:
                found = min(found, (SECOND + 1 - fit, -self.counts.get(ref, 0), ref))
        return found

    def best(self, field: str, value: str) -> tuple[float, int, int]:
        """(distance, minus the entry's count, entry); a miss has entry 0 and an infinite distance."""
        found = (float("inf"), 0, MISS)
        ways = forms(value)
        for words in ways:
            for key in (" ".join(words), " ".join(sorted(words)), "".join(words)):
                if (ref := self.exact.get((field, key))) is not None:
                    return (0.0, -self.counts.get(ref, 0), ref)
        for words in ways:
            key = (field, *words)
            if key not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = self._near(field, words)
            found = min(found, self.known[key])
        if found[0] == float("inf"):
            for words, dotted in cut_forms(value):
                key = (field, *words, "", *sorted(dotted))
                if key not in self.known:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[key] = self._fitting(field, words, dotted)
                found = min(found, self.known[key])
        return found

    def _near(self, field: str, words: list[str]) -> tuple[float, int, int]:
        key = " ".join(words)
        size = sum(map(len, words))
        most = (self.share if size > 5 else min(self.share, 0.3)) * size if size >= LEAST else 0
        shared: Counter[int] = Counter()
        for w in {*words, "".join(words)}:
            if len(w) > self.longest + 2:
                continue  # farther from every word than any bound
            ats: set[int] = set()
            for d in deletes(w, allowed(w)):
                ats |= self.index.get((field, d), set())
            for d in deletes(w, int(len(w) > 4)):
                ats |= self.starts.get((field, d), set())
            for at in ats:
                shared[at] += len(w)
        found = (float("inf"), 0, MISS)
        own = Counter("".join(words))
        for at, _ in shared.most_common():
            other, text, ref = self.phrases[field][at]
            bound = min(most, found[0])
            cost = bound + 1
            missing = (self.letters[field][at] - own).total(), (own - self.letters[field][at]).total()
            if max(missing) * 0.7 <= bound:
                cost = weighted_dl(key, text, bound)
            if cost > bound and len(words) == len(other) and missing[1] * 0.7 <= bound:
                cost = min(cost, self._word_by_word(words, other, bound))
            if cost <= bound:
                found = min(found, (cost, -self.counts.get(ref, 0), ref))
        return found

    @staticmethod
    def _word_by_word(words: list[str], other: list[str], most: float) -> float:
        """The words' distances, in any order; a word may be cut short."""
        left, cost = list(other), 0.0
        for i, w in sorted(enumerate(words), key=lambda x: -len(x[1])):
            ways = []
            for x in set(left):
                c = weighted_dl(w, x, most) + 0.1 * (i >= len(other) or other[i] != x)
                if len(w) > 2 and len(x) > len(w):
                    c = min(c, 0.1 + weighted_dl(w, x[: len(w)], most) + 0.1 * (other[i] != x))
                ways.append((c, x))
            c, x = min(ways)
            cost += c
            left.remove(x)
            if cost > most:
                break
        return cost


BEST = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType()), T.StructField("ref_id", T.LongType())])


def _matched(matcher: Matcher, fields: pd.Series, values: pd.Series) -> pd.DataFrame:
    out = [(None, None, None) if v is None or not v.strip() else matcher.best(f, v) for f, v in zip(fields, values, strict=True)]
    return pd.DataFrame(out, columns=["distance", "rank", "ref_id"]).astype({"distance": "Float64", "rank": "Int64", "ref_id": "Int64"})


def _frequent(refs: DataFrame, size: dict[str, int]) -> dict[tuple[str, str], int]:
    """Entries that hold a stem, for the stems of at least one entry in ``RARE`` of a field: as many as an entry's words by ``RARE`` at most."""

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, w) for f, c in zip(batch["field_path"], batch["canonical"], strict=True) for w in stems_of(c)], columns=["field_path", "stem"])

    counted = refs.mapInPandas(stems, "field_path string, stem string").groupBy("field_path", "stem").count()
    least = F.create_map(*[F.lit(x) for f, n in size.items() for x in (f, n / RARE)])
    return {(r["field_path"], r["stem"]): r["count"] for r in counted.where(F.col("count") >= least[F.col("field_path")]).collect()}


def map_to_list(values: DataFrame, refs: DataFrame, aliases: dict | None = None, outside: dict | None = None, block: int | None = None) -> DataFrame:
    """``values`` (field_path, value, ...) with ``ref_id`` and ``distance``; 0 where the list has no entry.

    ``refs`` has ref_id, field_path and canonical; entries without one of these are left out. Other columns of
    ``values`` are kept; those named ``ref_id`` or ``distance`` are replaced.
    """
    block = block or BLOCK
    values = values.drop("ref_id", "distance", "_best")
    spark = values.sparkSession
    refs = refs.dropna(subset=["ref_id", "field_path", "canonical"])
    distinct = durable(values.where("value IS NOT NULL").groupBy("field_path", "value").agg(F.count(F.lit(1)).alias("n")))
    listed = refs.select("field_path", F.col("canonical").alias("value"), "ref_id")
    ranked = durable(listed.join(distinct, ["field_path", "value"], "left").select("ref_id", "field_path", F.col("value").alias("canonical"), F.coalesce("n", F.lit(0)).alias("n")))
    size = {r["field_path"]: r["count"] for r in ranked.groupBy("field_path").count().collect()}  # one row for each field
    entries, known = sum(size.values()), distinct.count()
    if entries <= block:
        rows = sorted(ranked.collect())
        shared = spark.sparkContext.broadcast(Matcher([r[:3] for r in rows], {r["ref_id"]: r["n"] for r in rows}, aliases, outside))

        @F.pandas_udf(BEST)
        def match(fields: pd.Series, texts: pd.Series) -> pd.DataFrame:
            return _matched(shared.value, fields, texts)

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        best = distinct.repartition(parts, "field_path", "value").select("field_path", "value", match("field_path", "value").alias("_best"))
    else:
        parts, slices, holders = -(-entries // block), max(1, -(-known // VALUES)), _frequent(refs, size)

        def part_best(key: tuple, texts: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            rows = part.sort_values("ref_id")
            matcher = Matcher(zip(rows["ref_id"], rows["field_path"], rows["canonical"], strict=True), dict(zip(rows["ref_id"], rows["n"], strict=True)), aliases, outside, size=size, holders=holders)
            return pd.concat([texts[["field_path", "value"]].reset_index(drop=True), _matched(matcher, texts["field_path"], texts["value"])], axis=1)

        each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
        asked = distinct.select("field_path", "value", F.pmod(F.xxhash64("value"), F.lit(slices)).alias("slice"), each(parts, "part"))
        held = ranked.select("*", F.pmod(F.xxhash64("ref_id"), F.lit(parts)).alias("part"), each(slices, "slice"))
        by_part = asked.groupBy("part", "slice").cogroup(held.groupBy("part", "slice")).applyInPandas(part_best, "field_path string, value string, distance double, rank bigint, ref_id bigint")
        best = by_part.groupBy("field_path", "value").agg(F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "rank", "ref_id"))).alias("_best"))
    best = durable(best)
    if known <= MAPPED:
        best = F.broadcast(best)
    return values.join(best, ["field_path", "value"], "left").select(*values.columns, F.col("_best.ref_id").alias("ref_id"), F.col("_best.distance").alias("distance"))


def field_values(frames: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(field_path, key, value) of several fields {field_path: (frame, column)}."""
    parts = [df.select(F.lit(p).alias("field_path"), F.col(key), F.col(c).alias("value")) for p, (df, c) in frames.items()]
    return reduce(DataFrame.unionByName, parts)
