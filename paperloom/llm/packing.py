"""Containers of fixed capacity filled with items of varying length (problem 6).

Variable-capacity best fit, longest items first. Which item of a length stands where doesn't matter to the fill, so
the packing itself runs over the counts of each length: at most as many numbers as the largest capacity, whatever
the corpus. Equal containers are kept as one interval of container numbers, and all of an interval's containers
take their items at once. Where none has room, the capacity that costs least for each token is opened; at the
end each container is cut down to the smallest permitted capacity that holds its contents. This is done for the subsets of
the permitted capacities, and the cheapest packing is taken. Items then find their
container by their rank among the items of their length.

No text is split unless it alone exceeds the largest permitted capacity; then it gives full containers and a rest.
Null, empty and blank texts that have no tokens are returned with no container. Repeated ids are packed as often as
they occur; their parts are numbered alike.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.ranks import ranked

#: Tokens that a container costs besides its capacity; above 0, few large containers are preferred to many small ones.
OVERHEAD = 0
#: The plan that may use all capacities together.
JOINT = 0


@dataclass
class Packing:
    """Where the items of each length go, and the intervals of equal containers."""

    items: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first rank, first container, items in each
    bins: list[tuple[int, int, int, int]] = field(default_factory=list)  # first container, containers, capacity, used


def pack(counts: dict[int, int], capacities: Iterable[int], overhead: float = OVERHEAD) -> Packing:
    """The packing of ``counts`` {length: items} into containers of ``capacities``; no length exceeds the largest."""
    sizes = sorted(set(capacities))
    out, opened = Packing(), 0
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # space left: (first container, containers, capacity)
    spaces: list[int] = []

    def keep(space: int, first: int, n: int, capacity: int) -> None:
        if n:
            if not room[space]:
                insort(spaces, space)
            room[space].append((first, n, capacity))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = bisect_left(spaces, length)
        while left and at < len(spaces):
            space = spaces.pop(at)
            groups, each = room.pop(space), space // length
            while groups:
                first, n, capacity = groups.pop()
                if not left:
                    keep(space, first, n, capacity)
                    continue
                full = min(n, left // each)
                if full:
                    out.items.append((length, rank, first, each))
                    keep(space - each * length, first, full, capacity)
                    rank, left = rank + full * each, left - full * each
                if left and full < n:
                    out.items.append((length, rank, first + full, left))
                    keep(space - left * length, first + full, 1, capacity)
                    rank, left, full = rank + left, 0, full + 1
                keep(space, first + full, n - full, capacity)
            at = bisect_left(spaces, length)
        while left:
            fitting = [c for c in sizes if c >= length]
            capacity = min(fitting, key=lambda c: ((c + overhead) / (min(c // length, left) * length), -c))
            each = min(capacity // length, left)
            full = left // each
            out.items.append((length, rank, opened, each))
            keep(capacity - each * length, opened, full, capacity)
            opened, rank, left = opened + full, rank + full * each, left - full * each
    for space, groups in room.items():
        for first, n, capacity in groups:
            out.bins.append((first, n, sizes[bisect_left(sizes, capacity - space)], capacity - space))
    return out


def jointly(counts: dict[int, int], capacities: Iterable[int], overhead: float = OVERHEAD) -> Packing:
    """The cheapest packing by some or all of ``capacities``: of all their subsets up to six of them, of more the whole and each alone.

    Containers are cut down to any permitted capacity in the end, also to those that none was opened with.
    """
    sizes = sorted(set(capacities))
    subsets = [c for n in range(1, len(sizes) + 1) for c in combinations(sizes, n)] if len(sizes) <= 6 else [(c,) for c in sizes] + [tuple(sizes)]
    longest = max(counts, default=0)
    made = [pack(counts, s, overhead) for s in subsets if s[-1] >= longest]
    for done in made:
        done.bins = [(first, n, sizes[bisect_left(sizes, used)], used) for first, n, _, used in done.bins]
    return min(made, key=lambda done: sum(n * (capacity + overhead) for _, n, capacity, _ in done.bins))


@dataclass
class Placed:
    """The packings of all plans as sorted arrays: items of all plans and lengths, and all containers, are numbered through."""

    plans: np.ndarray  # ids, in order
    lengths: list[np.ndarray]  # of each plan, in order
    bases: list[np.ndarray]  # number of the first item of each length
    starts: np.ndarray  # number of the first item of each run of items that fill equal containers alike
    firsts: np.ndarray  # its first container
    eaches: np.ndarray  # its items in each
    bin_bases: np.ndarray  # number of each plan's first container
    bins: np.ndarray  # number of the first of each run of equal containers
    data: np.ndarray  # its capacity and use

    @classmethod
    def of(cls, packings: dict[int, tuple[dict[int, int], Packing]]) -> Placed:
        plans = sorted(packings)
        lengths, bases, bin_bases, runs, bins = [], [], [], [], []
        item = container = 0
        for plan in plans:
            counts, done = packings[plan]
            own = sorted(counts)
            base = dict(zip(own, item + np.concatenate([[0], np.cumsum([counts[n] for n in own])]), strict=False)) if own else {}
            lengths.append(np.array(own, np.int64))
            bases.append(np.array([base[n] for n in own], np.int64))
            bin_bases.append(container)
            runs += [(base[length] + rank, first, each) for length, rank, first, each in done.items]
            bins += [(container + first, capacity, used) for first, _, capacity, used in done.bins]
            item += sum(counts.values())
            container += sum(n for _, n, _, _ in done.bins)
        run, box = (np.array(sorted(x), np.int64).reshape(-1, 3) for x in (runs, bins))
        return cls(np.array(plans, np.int64), lengths, bases, run[:, 0], run[:, 1], run[:, 2], np.array(bin_bases, np.int64), box[:, 0], box[:, 1:])

    def find(self, plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        at = np.searchsorted(self.plans, plan)
        number = np.empty(len(plan), np.int64)
        for i in np.unique(at):
            mine = at == i
            number[mine] = self.bases[i][np.searchsorted(self.lengths[i], length[mine])] + rank[mine]
        run = np.searchsorted(self.starts, number, "right") - 1
        container = self.firsts[run] + (number - self.starts[run]) // self.eaches[run]
        box = np.searchsorted(self.bins, self.bin_bases[at] + container, "right") - 1
        return pd.DataFrame({"container_id": container, "capacity_tokens": self.data[box, 0], "used_tokens": self.data[box, 1]})


def pieces(counts: DataFrame, plans: dict[int, list[int]], key: str) -> DataFrame:
    """(pack_id, key, part, token_start, tokens): the items of each plan; n_tokens over the largest capacity is split."""
    tops = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pack_id"), F.lit(max(c)).cast("bigint").alias("top")) for p, c in plans.items()])
    each = counts.select(key, "n_tokens", F.inline(tops))
    cut = each.withColumn("part", F.explode(F.expr("sequence(0L, greatest(0L, (n_tokens - 1) div top))")))
    start = F.col("part") * F.col("top")
    return cut.select("pack_id", key, "part", start.alias("token_start"), F.least("top", F.col("n_tokens") - start).alias("tokens"))


def packed(counts: DataFrame, plans: dict[int, list[int]], key: str = "doc_id", overhead: float = OVERHEAD) -> DataFrame:
    """Items of each plan {pack_id: capacities} with container_id, capacity_tokens and used_tokens.

    ``counts`` has ``key`` and n_tokens, and should be durable: it is read twice.
    """
    items = pieces(counts, plans, key)
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for row in items.where("tokens > 0").groupBy("pack_id", "tokens").count().collect():  # bounded by the capacities
        histogram[row["pack_id"]][row["tokens"]] = row["count"]
    shared = counts.sparkSession.sparkContext.broadcast(Placed.of({p: (histogram[p], jointly(histogram[p], c, overhead)) for p, c in plans.items()}))

    @F.pandas_udf("container_id bigint, capacity_tokens bigint, used_tokens bigint")
    def place(plan: pd.Series, length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return shared.value.find(plan.to_numpy(np.int64), length.to_numpy(np.int64), rank.to_numpy(np.int64))

    filled = ranked(items.where("tokens > 0"), ["pack_id", "tokens"], [], [key, "part"]).withColumn("_to", place("pack_id", "tokens", "rank"))
    columns = ["pack_id", key, "part", "token_start", "tokens"]
    none = [F.lit(None).cast("bigint").alias(n) for n in ("container_id", "capacity_tokens", "used_tokens")]
    return filled.select(*columns, "_to.*").unionByName(items.where("tokens = 0").select(*columns, *none))


def fill_report(result: DataFrame) -> DataFrame:
    """For each plan: containers, tokens, capacity, the share of it that is used, and how far it is from the least possible.

    ``least_tokens`` bounds the capacity that any packing needs: where one capacity is permitted, as many containers as
    hold all tokens or all items over half of it; else the tokens. ``gap`` is the capacity over that, less 1.
    """
    bins = result.where("container_id IS NOT NULL").groupBy("pack_id", "container_id").agg(F.sum("tokens").alias("used"), F.first("capacity_tokens").alias("capacity"), F.sum((F.col("tokens") * 2 > F.col("capacity_tokens")).cast("bigint")).alias("large"))
    total = bins.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("capacity").alias("capacity_tokens"), F.max(F.col("used") - F.col("capacity")).alias("most_over"), F.min("capacity").alias("_small"), F.max("capacity").alias("_large"), F.sum("large").alias("_halves")
    )
    least = F.when(F.col("_small") == F.col("_large"), F.greatest(F.ceil(F.col("tokens") / F.col("_large")), F.col("_halves")) * F.col("_large")).otherwise(F.col("tokens"))
    sized = total.withColumn("fill", F.col("tokens") / F.col("capacity_tokens")).withColumn("least_tokens", least).withColumn("gap", F.col("capacity_tokens") / F.col("least_tokens") - 1)
    return sized.drop("_small", "_large", "_halves")
