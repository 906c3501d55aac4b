"""Writing registries, reports and summaries."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import registry


def write_text(path: str, content: str) -> None:
    """A small file of the driver, whole or not at all: a temporary file beside it, then renamed."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_documents(df: DataFrame, root: str, stem: str = "stem", path: str = "file_path") -> None:
    """Records as JSON, in a folder for each type; those of equal stems get numbered names."""
    registry.numbered_names(df, stem, path).write.mode("overwrite").partitionBy("doc_type").json(root)


#: Folders that a registry's keys are spread over; only those that a batch touches are read and rewritten.
BUCKETS = 64
# What an error says where the files themselves are at fault.
UNREADABLE = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def write_registry(df: DataFrame, path: str, key: list[str], order: str) -> None:
    """Puts exportable rows into the registry at ``path`` by identity; the same batch put twice leaves the same table.

    Rows lie in ``BUCKETS`` folders by a hash of their key. A batch's folders are written beside the registry and
    swapped in one by one; the former ones stay in ``path.old`` until all are in place, and a run that broke off is mended
    before the next one starts. A registry that can't be read is moved to ``path.unreadable`` with a number, and a new
    one begun.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, stage, old = (hadoop.Path(f"{path}{end}") for end in ("", ".new", ".old"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(root: Any) -> list[str]:
        return [n for n in (s.getPath().getName() for s in system.listStatus(root)) if n.startswith("_bucket=")] if system.exists(root) else []

    for name in set(folders(old)) - set(folders(target)):
        system.rename(hadoop.Path(old, name), hadoop.Path(target, name))
    system.delete(old, True)
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
    new = registry.exportable(df).withColumn("_bucket", bucket)
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # BUCKETS at most
    former = new.limit(0)
    if folders(target):
        try:
            former = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
        except (PySparkException, Py4JJavaError) as e:
            if not any(sign in str(e) for sign in UNREADABLE):
                raise
            n = 1
            while system.exists(aside := hadoop.Path(f"{path}.unreadable{n}")):
                n += 1
            system.rename(target, aside)
    registry.merged(former, new, [*key], order).repartition("_bucket", *key).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.new")
    system.mkdirs(target)
    system.mkdirs(old)
    for name in folders(stage):
        if system.exists(hadoop.Path(target, name)):
            system.rename(hadoop.Path(target, name), hadoop.Path(old, name))
        system.rename(hadoop.Path(stage, name), hadoop.Path(target, name))
    system.delete(old, True)
    system.delete(stage, True)


def append_history(df: DataFrame, path: str) -> None:
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def report(summary: DataFrame, title: str) -> str:
    """A summary, one row for each type, as a Markdown table."""
    rows = summary.toPandas()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows.itertuples(index=False)]
    return "\n".join(lines) + "\n"


def write_metrics(summary: DataFrame, path: str) -> None:
    write_text(path, json.dumps([r.asDict(True) for r in summary.collect()], ensure_ascii=False, default=str, indent=1))
