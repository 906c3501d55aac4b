"""Spellings of one person, organisation, authority or court, linked (problem 3).

Trie join. The cores of all names (surnames, firms, places) are put into tries, one for each shard: shards are the
first letters of a core (eight, four in short cores) less as many of them as slips are allowed, in all ways: cores
within that many slips share a part of their letters in order, so they meet in a shard. Where a shard is too large
for one trie, it is cut by the last letters in the same way, and what is still too large into blocks of entries and
of queries. A core walks down the tries of its shards with a Levenshtein automaton (bits of a number are its states),
which enumerates its neighbours of at most two slips (one where both cores are under eight letters), whatever their length.

Token orders. The parser in ``names`` tells surname, first name and patronymic by their place and endings, with lists of
first names as a help. Of an organisation's words every order is looked up (over four words: the alphabetical one).

Names that agree in all parts are one node. A node with missing or cut parts, or with slips that typing makes, hangs
on the best node that has them in full or is written in more ways. Whether two nodes belong together doesn't depend on
how often they occur, only which of them is taken for the right one. What hangs together is one entity.

Nodes meet on core and pattern: a node answers to the patterns that its slots can be cut down to, and asks for its own
and those within two slips of it. Namesakes of other first names or patronymics never meet.

Nulls, blanks and stand-ins are in no entity. Repeated rows count, but give no further spellings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import names
from paperloom.session import durable

#: Least length of the longer core for one and for two slips.
ONE, TWO = 4, 8
#: Cores of one shard that go into one trie.
TRIE = 200_000
_S = T.StringType()
PARSED = T.StructType([T.StructField(n, T.ArrayType(_S) if n == "cores" else T.BooleanType() if n == "full" else _S) for n in ("kind", "block", "cores", "slot1", "slot2", "full", "plain")])


def slips(longer: int) -> int:
    """Slips that two cores may be apart of which the longer one has so many letters."""
    return 0 if longer < ONE else 1 if longer < TWO else 2


@F.pandas_udf(PARSED)
def _read(values: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    out = []
    for value, kind in zip(values, kinds, strict=True):
        n = names.read(value, kind)
        out.append((n.kind, n.block, list(n.cores), n.slot1, n.slot2, n.full, names.plain(value)) if n else (None,) * 7)
    return pd.DataFrame(out, columns=["kind", "block", "cores", "slot1", "slot2", "full", "plain"], dtype=object)


# A filter on its result would else be moved before the aggregation, and every row would be parsed.
_read = _read.asNondeterministic()


def spellings(frames: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(field_path, name, n, parts...) of every distinct value of fields {field_path: (frame, column, kinds)}."""
    parts = [df.select(F.lit(p).alias("field_path"), F.lit(k).alias("kinds"), F.col(c).alias("name")) for p, (df, c, k) in frames.items()]
    distinct = reduce(DataFrame.unionByName, parts).where(F.col("name").isNotNull()).groupBy("field_path", "kinds", "name").agg(F.count(F.lit(1)).alias("n"))
    distinct = _spread(distinct, "name")
    read = distinct.withColumn("_p", _read("name", "kinds")).where(F.col("_p.kind").isNotNull())
    space = F.concat_ws("|", "field_path", "_p.kind", "_p.block")
    return read.select("field_path", "name", "n", space.alias("space"), "_p.kind", "_p.cores", F.col("_p.cores")[0].alias("core"), "_p.slot1", "_p.slot2", "_p.full", "_p.plain")


class Automaton:
    """States of the Levenshtein automaton of one word: bit i of number d says that i letters are read with d slips."""

    def __init__(self, word: str, most: int):
        self.word, self.most, self.end, self.full = word, most, 1 << len(word), (2 << len(word)) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 2 << i
        self.start = tuple((2 << d) - 1 & self.full for d in range(most + 1))

    def step(self, now: tuple, before: tuple | None, c: str, previous: str) -> tuple:
        """The states after letter ``c``; ``before`` are those before the letter ``previous``."""
        at = self.at.get(c, 0)
        low = now[0] << 1 & at
        out = [low]
        for d in range(1, self.most + 1):
            new = now[d] << 1 & at | now[d - 1] | (now[d - 1] | low) << 1
            if before is not None:
                new |= before[d - 1] << 2 & at << 1 & self.at.get(previous, 0)
            low = new & self.full
            out.append(low)
        return tuple(out)

    def slips(self, states: tuple) -> int:
        """Slips of what was read, or more than ``most``."""
        return next((d for d, s in enumerate(states) if s & self.end), self.most + 1)

    def walk(self, trie: dict) -> Iterator[tuple[str, int]]:
        """(entry, slips) of the entries of ``trie`` within ``most`` slips; a swap is one slip."""
        stack = [(trie, "", self.start, None, "")]
        while stack:
            node, path, now, before, previous = stack.pop()
            if "" in node and (d := self.slips(now)) <= self.most:
                yield path, d
            for c, child in node.items():
                if not c:
                    continue
                states = self.step(now, before, c, previous)
                if not states[-1]:
                    continue
                if isinstance(child, dict):
                    stack.append((child, path + c, states, now, c))
                    continue
                last, older, was = states, now, c
                for x in child:  # the rest of the only entry below
                    last, older, was = self.step(last, older, x, was), last, x
                    if not last[-1]:
                        break
                else:
                    if (d := self.slips(last)) <= self.most:
                        yield path + c + child, d


def add(trie: dict, word: str) -> None:
    """Puts ``word`` into ``trie``; an entry's rest below which nothing branches stays one text."""
    node = trie
    for i, c in enumerate(word):
        child = node.get(c)
        if child is None:
            node[c] = word[i + 1 :]
            return
        if isinstance(child, str):
            child = node[c] = {child[0]: child[1:]} if child else {"": True}
        node = child
    node[""] = True


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a shard come together; its trie and its queries live only until the next one's rows come."""
    shard, rows = None, []

    def found() -> set[tuple[str, str, str, int]]:
        tries: dict[str, dict] = {}
        for space, core, entry, _ in rows:
            if entry:
                add(tries.setdefault(space, {}), core)
        out = set()
        for space, core, _, query in rows:
            if query and space in tries:
                n = len(core)
                for other, d in Automaton(core, slips(n + 2)).walk(tries[space]):
                    if other != core and d <= slips(max(n, len(other))):
                        out.add((space, core, other, d))
        return out

    def frame(out: set) -> pd.DataFrame:
        return pd.DataFrame(list(out), columns=["space", "core", "other", "slips"])

    for batch in batches:
        out: set[tuple[str, str, str, int]] = set()
        for at, *row in zip(batch["shard"], batch["space"], batch["core"], batch["entry"], batch["query"], strict=True):
            if at != shard:
                out |= found()
                shard, rows = at, []
            rows.append(row)
        yield frame(out)
    yield frame(found())


def _signatures(core: Column, slips: int, whole: int) -> Column:
    """The first ``whole`` letters less ``slips`` of them, in all ways; cores that so many slips tell apart share one."""
    out = []
    for places in combinations(range(1, whole + 1), whole - slips):
        kept = F.concat(F.lit(str(slips)), *[F.substring(core, i, 1) for i in places])
        out.append(F.when(F.length(core) >= places[-1], kept))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _by_slips(core: Column) -> Column:
    """Signatures of a core for one slip among short ones, and for two where a longer one may be the other."""
    n, none = F.length(core), F.array().cast("array<string>")
    short = F.when(n.between(ONE - 1, TWO - 1), _signatures(core, 1, ONE)).otherwise(none)
    return F.array_distinct(F.concat(short, F.when(n >= TWO - 2, _signatures(core, 2, TWO)).otherwise(none)))


def _spread(df: DataFrame, *key: Column | str) -> DataFrame:
    """``df`` over as many tasks as the session shuffles to: a given number isn't merged into fewer."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def neighbours(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(space, core, other, slips): the ``entries`` that few slips tell from a core of ``queries`` in the same space.

    Both have space and core. Repeated rows count once. A null core has no neighbours.
    """
    sides = [df.select("space", "core", F.lit(e).alias("entry"), F.lit(not e).alias("query")) for df, e in ((entries, True), (queries, False))]
    both = durable(sides[0].unionByName(sides[1]).groupBy("space", "core").agg(F.max("entry").alias("entry"), F.max("query").alias("query")))
    routed = both.select("*", F.explode(_by_slips(F.col("core"))).alias("_s")).withColumn("shard", F.xxhash64("space", "_s")).drop("_s")
    sized = durable(_sizes(routed))
    shards = routed.join(sized.where(F.col("most") <= TRIE).select("shard"), "shard")
    if sized.where(F.col("most") > TRIE).limit(1).count():
        shards = shards.unionByName(_cut(routed.join(sized.where(F.col("most") > TRIE).select("shard"), "shard")).select(shards.columns))
    # By the shard itself the join's partitions would serve, and these are read piecewise where the join turns out small or skewed.
    walked = _spread(shards, F.xxhash64("shard")).sortWithinPartitions("shard").mapInPandas(_walk, "space string, core string, other string, slips int")
    return durable(walked.distinct())


def _sizes(routed: DataFrame) -> DataFrame:
    """Cores of each shard in which a query may meet another core."""
    sums = routed.groupBy("shard").agg(*[F.sum(F.col(c).cast("bigint")).alias(f"_{c}") for c in ("entry", "query")], F.count(F.lit(1)).alias("most"))
    return sums.where("_entry > 0 AND _query > 0 AND most > 1").drop("_entry", "_query")


def _cut(large: DataFrame) -> DataFrame:
    """Rows of large shards cut by the cores' last letters, and what is still large into blocks, each with each other."""
    finer = large.withColumn("_s", F.explode(_by_slips(F.reverse("core")))).withColumn("shard", F.xxhash64("shard", "_s")).drop("_s")
    placed = finer.join(_sizes(finer).select("shard", F.ceil(F.col("most") / F.lit(TRIE)).alias("_n")), "shard")
    own = F.pmod(F.xxhash64("core"), F.col("_n"))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    as_entry = F.when(F.col("entry"), F.transform(others, lambda j: F.struct(own.alias("e"), j.alias("q"), F.lit(True).alias("entry"), (F.col("query") & (j == own)).alias("query"))))
    as_query = F.when(F.col("query"), F.transform(F.filter(others, lambda j: ~F.col("entry") | (j != own)), lambda j: F.struct(j.alias("e"), own.alias("q"), F.lit(False).alias("entry"), F.lit(True).alias("query"))))
    none = F.array().cast("array<struct<e:bigint,q:bigint,entry:boolean,query:boolean>>")
    blocks = placed.select("shard", "space", "core", F.inline(F.concat(F.coalesce(as_entry, none), F.coalesce(as_query, none))))
    return blocks.withColumn("shard", F.xxhash64("shard", "e", "q")).drop("e", "q")


@F.pandas_udf(T.DoubleType())
def _cost(kind: pd.Series, core: pd.Series, other: pd.Series, a1: pd.Series, b1: pd.Series, a2: pd.Series, b2: pd.Series, mine: pd.Series) -> pd.Series:
    out = []
    for k, c, o, p, q, r, s, own in zip(kind, core, other, a1, b1, a2, b2, mine, strict=True):
        cost = 0.0 if own else 0.2
        if c != o:
            cost += min(names.typo_cost(c, o), names.typo_cost(o, c) + 0.5)
        for x, y in ((p, q), (r, s)):
            cost += names.slot_cost(x, y, k)
        out.append(cost)
    return pd.Series(out, dtype="float64")


def _forms(slot: Column, person: Column) -> tuple[Column, Column]:
    """(the slot's alternatives, cut ones as one initial; their initials)."""
    initial = lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))
    own = F.transform(F.split(slot, r"\|"), lambda x: F.when(person & F.endswith(x, F.lit(".")), initial(x)).otherwise(x))
    return own, F.when(person & (slot != ""), F.transform(own, initial)).otherwise(F.array(F.lit("")))


def _crossed(first: Column, second: Column, sign: str = "") -> Column:
    return F.array_distinct(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.concat(F.lit(sign), x, F.lit("\x02"), y)))))


def _patterns() -> tuple[Column, Column]:
    """(patterns that a node asks for, patterns that it answers to), by its slots.

    A node answers to its slots in full, as initials, and missing. A node whose own slots are cut answers to their
    initials under the sign ``!`` besides, which those ask for that have more of one slot and less of the other.
    """
    person, nothing = F.col("kind") == "p", F.array(F.lit(""))
    (own1, cut1), (own2, cut2) = _forms(F.col("slot1"), person), _forms(F.col("slot2"), person)
    cut = person & (F.endswith("slot1", F.lit(".")) | F.endswith("slot2", F.lit(".")))
    none = F.array().cast("array<string>")
    answers = F.concat(_crossed(F.concat(own1, cut1, nothing), F.concat(own2, cut2, nothing)), F.when(cut, _crossed(F.concat(cut1, nothing), F.concat(cut2, nothing), "!")).otherwise(none))
    asks = F.concat(_crossed(own1, own2), F.when(person & ~F.col("full"), _crossed(cut1, cut2, "!")).otherwise(none))
    return F.array_distinct(asks), F.array_distinct(answers)


def entities(read: DataFrame) -> DataFrame:
    """(field_path, name, entity) of :func:`spellings`' rows."""
    node = ["space", "kind", "core", "slot1", "slot2"]
    read = durable(read.withColumn("node", F.sha2(F.concat_ws("\x01", *node), 256)))
    complete = F.when(F.col("full"), 2.0).otherwise(F.when(F.col("slot1") != "", 0.5).otherwise(0.0) + F.when(F.col("slot2") != "", 0.5).otherwise(0.0))
    asks, answers = _patterns()
    grouped = read.groupBy("node", *node).agg(F.array_distinct(F.flatten(F.collect_set("cores"))).alias("cores"), F.max(complete).alias("complete"), F.max("full").alias("full"), F.countDistinct("plain").alias("ways"), F.sum("n").alias("n"))
    nodes = durable(grouped.withColumn("asks", asks).withColumn("answers", answers))
    # one trie join for cores and for patterns, each in their own spaces
    slots = F.concat(F.lit("slots|"), "kind")
    spelt = (F.col("kind") != "o") & (F.greatest(F.length("slot1"), F.length("slot2")) > 4)
    sought = lambda space, cores: nodes.where(spelt).select(space.alias("space"), F.explode(F.filter(cores, lambda x: ~F.startswith(x, F.lit("!")))).alias("core"))
    known = F.filter("cores", lambda x: (x == F.col("core")) | F.startswith(x, F.lit(names.SORTED)))
    entries = nodes.select("space", F.explode(known).alias("core")).unionByName(sought(slots, F.col("answers")))
    queries = nodes.select("space", F.explode("cores").alias("core")).unionByName(sought(slots, F.col("asks")))
    near = neighbours(entries, queries)
    own = ["node", "kind", "core", "slot1", "slot2", "complete", "full", "ways", "n"]
    asked = nodes.select("space", F.explode("cores").alias("asked"), "asks", *own).select("space", "asked", F.explode("asks").alias("ask"), *own)
    exact = asked.withColumn("to", F.col("asked")).withColumn("slips", F.lit(0))
    by_core = near.select("space", F.col("core").alias("asked"), F.col("other").alias("to"), "slips")
    by_slot = near.select(F.col("space").alias("_slots"), F.col("core").alias("ask"), F.col("other").alias("_ask"), F.col("slips").alias("_slips"))
    wide = exact.unionByName(asked.join(by_core, ["space", "asked"]))
    wider = wide.where(spelt).withColumn("_slots", slots).join(by_slot, ["_slots", "ask"]).where(F.col("slips") + F.col("_slips") <= 2).withColumn("ask", F.col("_ask"))
    wide = wide.unionByName(wider.select(wide.columns))
    target = nodes.select("space", F.explode(known).alias("to"), "answers", *[F.col(c).alias(f"_{c}") for c in ("node", "slot1", "slot2", "complete", "full", "ways", "n")]).withColumn("ask", F.explode("answers")).drop("answers")
    pairs = wide.join(target, ["space", "to", "ask"]).where("node <> _node")
    greater = F.when(F.col("full") & F.col("_full"), F.struct("_ways", "_n", "_node") > F.struct("ways", "n", "node")).otherwise(F.struct("_complete", "_ways", "_n", "_node") > F.struct("complete", "ways", "n", "node"))
    priced = pairs.where(greater).withColumn("cost", _cost("kind", "asked", "to", "slot1", "_slot1", "slot2", "_slot2", F.col("asked") == F.col("core")))
    rank = F.struct((~F.col("_full")).alias("a"), F.round("cost").alias("b"), (-F.col("_ways")).alias("c"), (-F.col("_n")).alias("d"), F.col("cost").alias("e"), F.col("_node").alias("up"))
    best = priced.where("cost < 3").groupBy("node").agg(F.min(rank)["up"].alias("up"))
    parent = durable(nodes.select("node").join(best, "node", "left").select("node", F.coalesce("up", "node").alias("up")))
    return read.join(roots(parent), "node").select("field_path", "name", F.col("up").alias("entity"))


def roots(parent: DataFrame) -> DataFrame:
    """``parent`` (node, up) with each node's root: pointers are doubled until nothing changes."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("_upper")).where("up <> _upper")
        parent = durable(parent.join(above, "up", "left").select("node", F.coalesce("_upper", "up").alias("up"), F.col("_upper").isNotNull().alias("_moved")))
        if not parent.where("_moved").limit(1).count():
            return parent.drop("_moved")
        parent = parent.drop("_moved")


def pairs_of(linked: DataFrame) -> DataFrame:
    """(field_path, name_a, name_b): the pairs of spellings of one entity, name_a < name_b."""
    other = linked.select("field_path", "entity", F.col("name").alias("name_b"))
    return linked.join(other, ["field_path", "entity"]).where(F.col("name") < F.col("name_b")).select("field_path", F.col("name").alias("name_a"), "name_b")
