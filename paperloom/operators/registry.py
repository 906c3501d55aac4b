"""Registries of records: deliveries merged by identity, resumed runs, canonical copies, caches, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("file_path", "file_name", "doc_type")


def identity(*columns: str) -> Column:
    """The key of a record: path, name and type; nulls are empty."""
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or IDENTITY])


def latest(df: DataFrame, key: Column, order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``, aggregated before the shuffle; no key's rows are sorted in one task."""
    columns = keep or df.columns
    best = df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def merged(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or replaced by identity; within each side the last by ``order`` holds."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, identity(*key), [F.col("_side"), F.col(order)]).drop("_side")


def exportable(df: DataFrame) -> DataFrame:
    """Rows that neither failed nor came from a failed extraction."""
    failed = F.coalesce(F.col("status") == "FAILED", F.lit(False))
    return df.where(~failed & ~F.coalesce(F.col("extraction_failed"), F.lit(False)))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def canonical(full: DataFrame, legacy: DataFrame, stem: str) -> DataFrame:
    """``full``, and of ``legacy`` what it lacks by stem."""
    return full.unionByName(legacy.join(full.select(stem).distinct(), stem, "left_anti"), allowMissingColumns=True)


def numbered_names(df: DataFrame, stem: str, path: str) -> DataFrame:
    """``df`` with ``save_as``: the stem, from the second path on with ``__2``, ``__3`` ..."""
    owners = df.select(stem, path).distinct()
    n = F.row_number().over(Window.partitionBy(stem).orderBy(path))
    named = owners.withColumn("_n", n).withColumn("save_as", F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat_ws("__", stem, "_n"))).drop("_n")
    return df.join(named, [stem, path])


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts; null parts are empty."""
    return F.sha2(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_split(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, misses) of the requests."""
    return requests.join(cache, key), requests.join(cache.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, n: int, order: str, tie: str) -> DataFrame:
    """The ``n`` newest rows: a bounded history, or what an LRU cache keeps. A top-n, not a sort of all rows."""
    return df.orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc()).limit(n)
