"""A session with the settings that results rely on."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tapeworks", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; shuffle partitions are left to the cluster and coalesced at run time."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names.

    Where none is named a local session gets one of its own; on a cluster that is an error, as executors see no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tapeworks-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tapeworks-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table, in a folder that driver and executors share."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, so that what reads it several times doesn't work it out again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> set[str]:
    """The intermediate tables that there are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().toString() for x in files.listStatus(folder)} if files.exists(folder) else set()


def clear(spark: SparkSession, paths: set[str] | None = None) -> None:
    """Deletes intermediate tables, all by default. A query's frame reads its tables: clear when its result is written."""
    for path in tables(spark) if paths is None else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for a Spark context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tapeworks_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.is_dir():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
            for f in sorted(home.rglob("*.py")):
                out.write(f, f"{home.name}/{f.relative_to(home)}")
        path = Path(tempfile.mkdtemp(prefix="tapeworks-")) / "tapeworks.zip"  # the driver serves it to the executors
        path.write_bytes(data.getvalue())
        context.addPyFile(str(path))
    context._tapeworks_shipped = True
