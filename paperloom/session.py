"""Session helpers: building a local session, cutting lineage durably."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("paperloom")
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the executors' Python, once for each context, wherever they run.

    The archive goes to the shared folder where the cluster names one.
    """
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, Path(package.name) / source.relative_to(package))
    name = f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    if shared := _shared_folder(spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(shared, name)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(packed.getvalue())
        out.close()
        context.addPyFile(path.toString())
    else:
        local = Path(tempfile.mkdtemp(prefix="paperloom-")) / name
        local.write_bytes(packed.getvalue())
        context.addPyFile(str(local))
    context._paperloom_shipped = True


def ship_active() -> None:
    """:func:`ship` for the active session, where there is one; functions that run Python in the executors call it."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back.

    The folder is the one named in ``spark.checkpoint.dir``. Only where that is unset, as in tests, a
    temporary folder of this machine is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    ship(spark)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared_folder(spark) or tempfile.mkdtemp(prefix="paperloom-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
