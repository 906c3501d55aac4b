"""Language of documents and of their lines (problem 8).

Word-first backoff. A word met in training scores by its log frequency in each language; a word never met falls
back to the longest character n-grams of it that were met, five letters down to one. A line takes the sum over its
words, a document the language of most letters in its lines.

The model is fitted on at most ``SAMPLE`` documents of at most ``SAMPLE_BYTES`` together, whole texts from the labels as
delivered: from each label's documents, and from those without one, the same number with the smallest hashes of their ids. As
these are partly wrong and some texts mix languages, it then labels the lines of the sample itself and is fitted
again on those, a few times over. Corpora of every size take the same way; all documents and whole texts are
labelled, each where it is read.

Null, empty and blank texts, and lines under ``LEAST_LETTERS`` letters, have no language. Of equal languages the
first in ``LANGS`` wins. Repeated ids keep their rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.glyphs import unify

LANGS = ("ru", "en", "uk", "be", "kk", "de")
#: Bounds of the documents that the model is fitted on, and of the bytes of their texts.
SAMPLE, SAMPLE_BYTES = 3_000, 64 << 20
ROUNDS, LONGEST, LEAST_LETTERS, REMEMBERED = 3, 5, 20, 300_000
# Frequent words that belong to the languages, the first evidence where labels are few.
SEEDS = {
    "ru": "и в не на что по из для был быть от это его если или до при также срок суд настоящий который которых",
    "en": "the and of to in is that for with was be by on shall which from has not this at been an or are",
    "uk": "і в не на що та до за із для був бути від це його якщо або при також строк суд цей який яких",
    "be": "і ў не на што па з для быў быць ад гэта яго калі або да пры таксама тэрмін суд гэты які якіх",
    "kk": "және мен бұл үшін болып бойынша осы туралы деп бар жоқ күні соттың тиіс дейін кейін арқылы бірақ оны емес",
    "de": "der die das und in zu den ist nicht von mit des ein eine dem im für auf wird oder bis sich nach bei",
}
# Names of the languages besides their codes.
NAMES = {
    "ru": "rus russian русский russisch",
    "en": "eng english английский englisch",
    "uk": "ukr ukrainian украинский українська ua",
    "be": "bel belarusian belarussian белорусский беларуская by",
    "kk": "kaz kazakh казахский қазақша kz",
    "de": "deu ger german немецкий deutsch",
}
CODES = {n: code for code, names in NAMES.items() for n in (code, *names.split())}
_WORDS = re.compile(r"[^\W\d_]+")


def code_of(label: str | None) -> str | None:
    """The language that a label names, in whatever notation; None where it names none of ``LANGS``."""
    return CODES.get(re.split(r"[-_\s(]", (label or "").strip().lower())[0])


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def lines_of(text: str | None) -> Iterator[tuple[int, list[str], int]]:
    """(number, words, letters) of the lines that have a language."""
    number = -1
    for line in (text or "").split("\n"):
        if not line or line.isspace():
            continue
        number += 1
        words = _WORDS.findall(line.lower())
        letters = sum(map(len, words))
        if letters >= LEAST_LETTERS:
            yield number, words, letters


def _logs(counts: list[Counter[str]], keys: Iterable[str]) -> dict[str, np.ndarray]:
    totals = np.array([c.total() for c in counts], float)
    size = len(set().union(*counts)) or 1
    base = np.log(totals + 0.1 * size)
    return {k: np.log(np.array([c[k] for c in counts]) + 0.1) - base for k in keys}


class Model:
    """Log frequencies of words and of n-grams by language."""

    def __init__(self, counts: list[Counter[str]]):
        words = {w for c in counts for w, n in c.items() if n > 1}
        self.words = {k: v - v.max() for k, v in _logs(counts, words).items()}
        self.grams: dict[str, np.ndarray] = {}
        for n in range(1, LONGEST + 1):
            by = []
            for c in counts:
                g: Counter[str] = Counter()
                for w, k in c.items():
                    for x in grams(w, n):
                        g[x] += 1 + math.log(k)
                by.append(g)
            self.grams |= _logs(by, {x for g in by for x in g})

    def unseen(self, word: str) -> np.ndarray:
        plain = unify(word, "name")
        if plain != word and plain in self.words:
            return self.words[plain]
        for n in range(LONGEST, 0, -1):
            if found := [self.grams[x] for x in grams(plain, n) if x in self.grams]:
                score = np.mean(found, axis=0) * min(3.0, len(found))
                return score - score.max()
        return np.zeros(len(LANGS))


class Labeller:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.at = {w: i for i, w in enumerate(self.model.words)}
        self.table = np.zeros((REMEMBERED + len(self.at) + 1, len(LANGS)), np.float32)
        for w, i in self.at.items():
            self.table[i] = self.model.words[w]

    def _row(self, word: str) -> int:
        i = self.at.get(word)
        if i is None:
            i = self.at[word] = len(self.at)
            self.table[i] = self.model.unseen(word)
        return i

    def lines(self, texts: Iterable[str | None]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """((place of the text, number, letters) of each line, their scores)."""
        if len(self.at) > len(self.model.words) + REMEMBERED // 2:
            self._reset()
        where, rows, starts, parts = [], [], [], []
        for t, text in enumerate(texts):
            for number, words, letters in lines_of(text):
                where.append((t, number, letters))
                starts.append(len(rows))
                if len(self.at) + len(words) > len(self.table):
                    self._grow(len(words))
                rows += [self._row(w) for w in words]
            if len(rows) > 500_000:
                parts.append(np.add.reduceat(self.table[rows], starts))
                rows, starts = [], []
        if starts:
            parts.append(np.add.reduceat(self.table[rows], starts))
        return where, np.concatenate(parts) if parts else np.zeros((0, len(LANGS)), np.float32)

    def _grow(self, more: int) -> None:
        self.table = np.concatenate([self.table, np.zeros((more + len(self.table) // 2, len(LANGS)), np.float32)])


def confidence(scores: np.ndarray) -> np.ndarray:
    """Probability of the best language, with evidence tempered by its square root."""
    s = scores - scores.max(axis=1, keepdims=True)
    s = s / np.sqrt(np.maximum(1.0, np.abs(s).max(axis=1, keepdims=True) / 4))
    return 1 / np.exp(s).sum(axis=1)


def fitted(texts: list[str | None], labels: list[str | None]) -> Model:
    """The model of labelled texts; see the module."""
    seeds = [Counter(dict.fromkeys(SEEDS[l].split(), 2)) for l in LANGS]
    lines = [[(words, letters) for _, words, letters in lines_of(t)] for t in texts]
    counts = [Counter(c) for c in seeds]
    for own, label in zip(lines, labels, strict=True):
        if (code := code_of(label)) is not None:
            for words, _ in own:
                counts[LANGS.index(code)].update(words)
    for _ in range(ROUNDS):
        labeller = Labeller(Model(counts))
        counts = [Counter(c) for c in seeds]
        where, scores = labeller.lines(texts)
        for (t, k), best in zip(((t, k) for t, own in enumerate(lines) for k in range(len(own))), scores.argmax(axis=1), strict=True):
            counts[best].update(lines[t][k][0])
    return Model(counts)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    """The model of at most ``SAMPLE`` labelled documents; an id that repeats gives all its rows, so ids should be unique."""
    first = F.split(F.trim(F.lower(F.regexp_replace(label, r"^\s+", ""))), r"[-_\s(]")[0]
    group = F.coalesce(*[F.when(first.isin([n for n, c in CODES.items() if c == code]), code) for code in LANGS], F.lit(""))
    keyed = docs.select(F.xxhash64(key).alias("_h"), F.octet_length(text).alias("_bytes"), group.alias("_g"))
    rows = {r["_g"]: r["count"] for r in keyed.groupBy("_g").count().collect()}  # one for each language
    each = SAMPLE // (len(LANGS) + 1)
    near = F.lit(False)
    for code, n in rows.items():  # about twice as many as are taken, told by the hash alone
        near = near | (F.col("_g") == code) & (F.pmod("_h", F.lit(1 << 40)) < int(min(1.0, (2 * each + 50) / n) * (1 << 40)))
    taken, used, have = [], 0, Counter()
    for r in sorted(keyed.where(near).select("_g", "_h", F.coalesce("_bytes", F.lit(0)).alias("_bytes")).collect(), key=lambda r: (r["_h"] % (1 << 40), r["_h"])):
        if have[r["_g"]] < each and used + r["_bytes"] <= SAMPLE_BYTES:
            have[r["_g"]] += 1
            used += r["_bytes"]
            taken.append(r["_h"])
    hashes = docs.sparkSession.createDataFrame([(h,) for h in taken], "_h bigint").distinct()
    sample = docs.select(F.xxhash64(key).alias("_h"), text, label).join(F.broadcast(hashes), "_h").orderBy("_h").drop("_h").toPandas()
    return fitted(sample[text].tolist(), sample[label].tolist())


def labelled(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: lang, confidence and lines (line_no, letters, lang, confidence) of each text.

    Other columns are kept; one named ``found`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang:string,confidence:double,lines:array<struct<line_no:bigint,letters:bigint,lang:string,confidence:double>>>"

    @F.pandas_udf(kind)
    def label_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for texts in batches:
            where, scores = labeller.lines(texts)
            best, sure = scores.argmax(axis=1) if len(scores) else [], confidence(scores) if len(scores) else []
            lines: list[list[dict]] = [[] for _ in range(len(texts))]
            weight = np.zeros((len(texts), len(LANGS)))
            trust = np.zeros((len(texts), len(LANGS)))
            for (t, number, letters), b, c in zip(where, best, sure, strict=True):
                lines[t].append({"line_no": number, "letters": letters, "lang": LANGS[b], "confidence": float(c)})
                weight[t, b] += letters
                trust[t, b] += letters * c
            top = weight.argmax(axis=1)
            total = weight.sum(axis=1)
            yield pd.DataFrame(
                {
                    "lang": [LANGS[b] if n else None for b, n in zip(top, total, strict=True)],
                    "confidence": [trust[i, b] / total[i] if total[i] else None for i, b in enumerate(top)],
                    "lines": lines,
                }
            )

    return docs.withColumn("found", label_texts(F.col(text)))
