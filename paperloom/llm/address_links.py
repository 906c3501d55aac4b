"""Addresses that denote one building (problem 5).

Top-down hierarchy matching. Regions are settled first, then localities within their region, then streets within
their locality: spellings of one parent that slips of typing tell apart are one name, whichever is written in more
ways. An address that has all levels is its building.

An address that lacks a level inherits candidates. A locality without a region may lie in any region that has it, or
else one within two slips of it; a street without a locality is looked up in its region, or in all. A known
building answers to the patterns that its levels can be cut down to; a pattern knows its only building or how many it
has. The fewest slips win; if several buildings are left, the postal code's first digits may single one out. What is
still ambiguous stays so: the address is linked with none, keeps the number of its candidates, and its ``candidate_sets``
are the patterns under which :func:`candidates_of` lists them. No address meets all buildings of its street and house.

Nulls, blanks and values without a house denote no building. Values that no building fits stand for themselves.
Repeated rows count once. No column besides the address is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import names, postal
from paperloom.llm.name_links import _spread, neighbours, roots
from paperloom.session import durable

LEVELS = ("code", "region", "town", "sort", "gender", "street", "house")
#: What a slip takes from the confidence of a link.
TRUST = 0.9


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in LEVELS]))
def _read(values: pd.Series) -> pd.DataFrame:
    rows = [postal.read(v) for v in values]
    return pd.DataFrame([[getattr(r, n) if r else None for n in LEVELS] for r in rows], columns=list(LEVELS), dtype=object)


# A filter on its result would else be moved before the aggregation, and every row would be parsed.
_read = _read.asNondeterministic()


@F.pandas_udf(T.IntegerType())
def _slips(noisy: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([names.typo_cost(a, b) for a, b in zip(noisy, clean, strict=True)], dtype="int32")


def addresses(frames: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct addresses of (frame, column) with their levels."""
    distinct = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("address")) for df, c in frames]).where(F.col("address").rlike(r"\d")).groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return _spread(distinct, F.xxhash64("address")).withColumn("_a", _read("address")).where(F.col("_a.house").isNotNull()).select("address", "n", "_a.*")


class Names(NamedTuple):
    """Names of one level: what each stands for, and which are near those that were asked for."""

    settled: DataFrame  # space, core, to
    near: DataFrame  # space, core, other, slips


def name_level(known: DataFrame, loose: DataFrame) -> Names:
    """Names of ``known`` (space, core, address, n) settled among themselves, and those near ``loose`` (space, core).

    ``known`` may hold spaces that are only looked up, told by a null address.
    """
    vocabulary = durable(known.groupBy("space", "core").agg(F.countDistinct("address").alias("ways"), F.sum("n").alias("n")))
    own = vocabulary.where("ways > 0")
    found = neighbours(vocabulary.select("space", "core"), own.select("space", "core").unionByName(loose.select("space", "core")))
    near = durable(found.withColumn("slips", _slips("core", "other")).where("slips <= 2"))
    up = own.select("space", F.col("core").alias("other"), F.struct("ways", "n", F.col("core").alias("name")).alias("_up"))
    mine = own.select("space", "core", F.struct("ways", "n", F.col("core").alias("name")).alias("_own"))
    better = near.join(mine, ["space", "core"]).join(up, ["space", "other"]).where(F.col("_up") > F.col("_own"))
    best = better.groupBy("space", "core").agg(F.min(F.struct("slips", -F.col("_up.ways"), "other"))["other"].alias("_to"))
    at = lambda name: F.concat_ws("\x01", "space", name)
    parent = durable(own.join(best, ["space", "core"], "left").select(at("core").alias("node"), at(F.coalesce("_to", "core")).alias("up")))
    node, root = F.split("node", "\x01"), F.split("up", "\x01")
    return Names(roots(parent).select(node[0].alias("space"), node[1].alias("core"), root[1].alias("to")), near)


def _settled(rows: DataFrame, space: Column, level: str, named: Names) -> DataFrame:
    joined = rows.withColumn("space", space).withColumnRenamed(level, "core").join(named.settled, ["space", "core"], "left")
    return joined.withColumn(level, F.coalesce("to", "core")).drop("space", "core", "to")


def _has(*levels: str) -> Column:
    return reduce(Column.__and__, [F.col(c) != "" for c in levels])


def _pattern(*levels: Column | str) -> Column:
    return F.md5(F.concat_ws("\x01", *levels))


class Matched(NamedTuple):
    linked: DataFrame
    patterns: DataFrame


def matched(read: DataFrame) -> Matched:
    """:func:`addresses`' rows with their buildings, and the patterns (candidate_set, building) of known buildings."""
    lit, none, no_sets = F.lit, F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rows = durable(read)
    # regions
    regions = name_level(rows.where(_has("region")).select(lit("r").alias("space"), F.col("region").alias("core"), "address", "n"), rows.limit(0).select(lit("r").alias("space"), F.col("region").alias("core")))
    rows = durable(_settled(rows, lit("r"), "region", regions))
    # localities: within their region, and those without one in any
    in_region = F.concat(lit("t|"), F.col("region"))
    placed, lone = rows.where(_has("region", "town")), rows.where(_has("town") & ~_has("region")).select(lit("t").alias("space"), F.col("town").alias("core")).distinct()
    own = placed.select(in_region.alias("space"), F.col("town").alias("core"), "address", "n")
    towns = name_level(own.unionByName(own.select(lit("t").alias("space"), "core", none.alias("address"), "n")), lone)
    ways = towns.near.where("space = 't'").select(F.col("core").alias("asked"), F.col("other").alias("core"), "slips").unionByName(lone.select(F.col("core").alias("asked"), "core", lit(0).alias("slips")))
    where = ways.join(towns.settled, "core").groupBy("asked", F.substring("space", 3, 1 << 30).alias("in_region"), F.col("to").alias("in_town")).agg(F.min("slips").alias("town_slips"))
    least = where.groupBy("asked").agg(F.min("town_slips").alias("town_slips"))
    inherited = where.join(least, ["asked", "town_slips"])
    own_place = _settled(placed, in_region, "town", towns).withColumn("town_slips", lit(0)).withColumn("whole", _has("sort", "street"))
    lent = rows.where(_has("town") & ~_has("region")).join(inherited, F.col("town") == F.col("asked")).withColumn("region", F.col("in_region")).withColumn("town", F.col("in_town")).withColumn("whole", lit(False))
    townless = durable(rows.where(~_has("town") & _has("street")))
    full = durable(own_place.unionByName(lent.select(own_place.columns)))
    # streets: within their locality; those without one in their region, or in any
    in_town = F.concat(lit("s|"), F.col("region"), lit("|"), F.col("town"))
    abroad = F.concat(lit("s|"), F.col("region"))
    named = full.where(_has("street")).select(in_town.alias("space"), F.col("street").alias("core"), "address", "n")
    far = [full.where("whole").select(space.alias("space"), F.col("street").alias("core"), none.alias("address"), "n") for space in (abroad, lit("s|"))]
    asked = townless.select(abroad.alias("space"), F.col("street").alias("core"))
    streets = name_level(named.unionByName(far[0]).unionByName(far[1]), asked.distinct())
    full = durable(_settled(full.withColumn("raw", F.col("street")), in_town, "street", streets))
    # known buildings and the patterns that they answer to
    level = ["region", "town", "sort", "street", "house"]
    whole = full.where("whole").withColumn("building", _pattern(*level))
    three = F.substring("code", 1, 3)
    kinds = F.array(F.concat(lit("s"), F.col("sort")), F.concat(lit("g"), F.col("gender")), lit("*"))
    places = F.array(F.struct(F.col("region").alias("r"), F.col("town").alias("t")), F.struct(F.col("region").alias("r"), lit("*").alias("t")), F.struct(lit("*").alias("r"), lit("*").alias("t")))
    answers = whole.select("building", F.explode(F.array_distinct(F.array("street", "raw"))).alias("street"), "house", "gender", "sort", "region", "town", F.when(three != "", three).alias("three")).distinct()
    answers = answers.withColumn("kind", F.explode(kinds)).withColumn("place", F.explode(places)).select(_pattern("place.r", "place.t", "kind", "street", "house").alias("pattern"), "three", "building")
    patterns = durable(answers.distinct())
    count = [F.countDistinct("building").alias("many"), F.min("building").alias("only")]
    plain, coded = patterns.groupBy("pattern").agg(*count), patterns.where("three IS NOT NULL").groupBy("pattern", "three").agg(*[c.alias(f"{n}3") for c, n in zip(count, ("many", "only"), strict=True)])
    # what the others ask for
    kind = F.when(_has("sort"), F.concat(lit("s"), F.col("sort"))).otherwise(F.when(_has("gender"), F.concat(lit("g"), F.col("gender"))).otherwise(lit("*")))
    partly = full.where("NOT whole").select("address", three.alias("three"), _pattern("region", "town", kind, "street", "house").alias("pattern"), F.col("town_slips").alias("slips"))
    roads = streets.near.select(F.col("space").alias("_space"), F.col("core").alias("_street"), "other", "slips").unionByName(asked.distinct().select(F.col("space").alias("_space"), F.col("core").alias("_street"), F.col("core").alias("other"), lit(0).alias("slips")))
    far_off = townless.join(roads, (abroad == F.col("_space")) & (F.col("street") == F.col("_street"))).select("address", three.alias("three"), _pattern(F.when(_has("region"), F.col("region")).otherwise(lit("*")), lit("*"), kind, "other", "house").alias("pattern"), "slips")
    found = partly.unionByName(far_off).join(plain, "pattern").join(coded, ["pattern", "three"], "left")
    nearest = found.join(found.groupBy("address").agg(F.min("slips").alias("slips")), ["address", "slips"])
    one = F.when(F.col("many") == 1, F.col("only"))
    summed = nearest.groupBy("address", "slips").agg(
        F.countDistinct("only").alias("_only"), F.max("many").alias("_most"), F.sum("many").alias("_sum"), F.min(one).alias("_one"), F.sort_array(F.collect_set("pattern")).alias("candidate_sets"), F.countDistinct("only3").alias("_only3"), F.max("many3").alias("_most3"), F.min("only3").alias("_one3")
    )
    single, by_code = (F.col("_only") == 1) & (F.col("_most") == 1), (F.col("_only3") == 1) & (F.col("_most3") == 1)
    settled_one = F.when(single, F.col("_one")).when(by_code, F.col("_one3"))
    candidates = F.when(single, lit(1)).otherwise(F.greatest(F.col("_only"), F.when(F.col("_only") == 1, F.col("_most")).otherwise(F.col("_sum"))))
    trust = F.pow(lit(TRUST), F.col("slips")) / F.when(single, lit(1.0)).when(by_code, lit(1 / TRUST)).otherwise(candidates)
    loose = summed.select("address", F.coalesce(settled_one, _pattern(lit("address"), "address")).alias("building"), candidates.cast("bigint").alias("candidates"), trust.alias("confidence"), F.when(settled_one.isNull(), F.col("candidate_sets")).alias("candidate_sets"))
    done = whole.select("address", "building", lit(1).cast("bigint").alias("candidates"), lit(1.0).alias("confidence"), no_sets.alias("candidate_sets"))
    known = durable(done.unionByName(loose))
    left = rows.join(known, "address", "left_anti").select("address", _pattern(lit("levels"), "region", "town", "sort", "gender", "street", "house").alias("building"), lit(0).cast("bigint").alias("candidates"), lit(1.0).alias("confidence"), no_sets.alias("candidate_sets"))
    return Matched(known.unionByName(left), patterns)


def buildings(read: DataFrame) -> DataFrame:
    """(address, building, candidates, confidence, candidate_sets) of :func:`addresses`' rows.

    An ambiguous address is a building of its own, with the number of its candidates and their sets.
    """
    return matched(read).linked


def candidates_of(found: Matched) -> DataFrame:
    """(candidate_set, building): the candidates of the sets that ambiguous addresses name."""
    sets = found.linked.select(F.explode("candidate_sets").alias("pattern")).distinct()
    return found.patterns.join(sets, "pattern").select(F.col("pattern").alias("candidate_set"), "building").distinct()


def pairs_of(linked: DataFrame) -> DataFrame:
    """(address_a, address_b): the pairs of addresses of one building, address_a < address_b."""
    other = linked.select("building", F.col("address").alias("address_b"))
    return linked.join(other, "building").where(F.col("address") < F.col("address_b")).select(F.col("address").alias("address_a"), "address_b")
