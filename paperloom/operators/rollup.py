"""Summaries of scored and audited records, and of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_type(df: DataFrame, score: str, status: str, benchmarked: str) -> DataFrame:
    """For each type and in all (null): records, mean score, share with truth, and records of low status.

    The mean in all is that of the records, not of the types.
    """
    rows = df.rollup("doc_type").agg(
        F.count(F.lit(1)).alias("records"), F.bround(F.avg(score), 2).alias("mean_score"), F.count_if(F.col(benchmarked)).alias("with_truth"), F.count_if(F.col(status) == "needs_attention").alias("low"), F.grouping("doc_type").cast("int").alias("is_total")
    )
    return rows.withColumn("truth_share", F.bround(F.col("with_truth") * 100.0 / F.col("records"), 2))


def status_counts(df: DataFrame, status: str, names: list[str]) -> DataFrame:
    """Records of each type by status, a column for each of ``names``."""
    return df.groupBy("doc_type").agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])


def money_summary(df: DataFrame, amounts: list[Column], verified: Column) -> DataFrame:
    """For each type and in all: records, verified ones and the sum of the first amount that is neither null nor zero."""
    first = F.coalesce(*[F.when(a != 0, a) for a in amounts], F.lit(0.0))
    return df.rollup("doc_type").agg(F.count(F.lit(1)).alias("records"), F.count_if(verified).alias("verified"), F.bround(F.sum(first), 2).alias("amount"))


def calls(df: DataFrame, by: str, cached: Column, latency: str, tokens: Column) -> DataFrame:
    """For each ``by``: calls, cache hits, real calls, mean latency over real calls, tokens a second."""
    real = ~cached
    spent = F.sum(F.when(real, F.col(latency)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(cached).alias("cache_hits"), F.count_if(real).alias("real_calls"), F.avg(F.when(real, F.col(latency))).alias("mean_latency"), (F.sum(F.when(real, tokens)) / F.nullif(spent, F.lit(0.0))).alias("tokens_per_s"))


def running(df: DataFrame, key: str, order: list[str], value: Column, cell: Column | None = None) -> DataFrame:
    """``df`` with running counts and sums of each key, in order; a sum is null until its first value.

    ``cell`` is an expression that never falls along the order, such as the day: then only a key's rows within one cell come
    together, and what came before is added from the cells' own counts and sums, so that a key may hold any share of the
    rows. Rows of null keys are a key of their own.
    """
    at = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = df.withColumn("_value", value)
    if cell is None:
        w = at.partitionBy(key)
        return counted.withColumn("running_n", F.count(F.lit(1)).over(w)).withColumn("running_sum", F.sum("_value").over(w)).drop("_value")
    celled = counted.withColumn("_cell", cell)
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
    offsets = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.sum("_sum").over(before).alias("_sum"))
    w = at.partitionBy(key, "_cell")
    own = celled.withColumn("_own_n", F.count(F.lit(1)).over(w)).withColumn("_own_sum", F.sum("_value").over(w))
    joined = own.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_cell").eqNullSafe(F.col("_at")), "left")
    total = F.coalesce(F.col("_sum") + F.col("_own_sum"), "_sum", "_own_sum")
    return joined.withColumn("running_n", F.col("_n") + F.col("_own_n")).withColumn("running_sum", total).select(*df.columns, "running_n", "running_sum")


def exit_code(df: DataFrame, rank: Column) -> DataFrame:
    """The code of a run: that of its worst row (1, then 3, 4, 0); an empty run has 1."""
    order = F.when(rank == 1, 0).when(rank == 3, 1).when(rank == 4, 2).otherwise(3)
    return df.agg(F.coalesce(F.min_by(rank, order), F.lit(1)).alias("exit_code"))
