"""Consecutive numbers within groups, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a part of a cell holds at most, but for the chance of its hash.
PART = 500_000


def ranked(df: DataFrame, group: list[str], cells: list[str], order: list[str], salts: int | None = None) -> DataFrame:
    """``df`` with ``rank``, counted from 0 in each group by cells, a hash of ``order``, then ``order``.

    Counts of (group, cells, salt) are summed first; a row's rank is its number in its part plus the sum before it.
    A cell has as many parts as it would take if it held all of ``df``, which is counted: give it cheap to read.
    ``order`` must name rows uniquely for the ranks to be the same in every run.
    """
    salts = salts or max(1, -(-df.count() // PART))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = [*group, *cells, "_salt"]
    counts = salted.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*cells, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = salted.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return numbered.join(offsets, part).withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_salt", "_i", "_before")
