"""The session that queries expect, and where intermediate tables are written."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results rely on; sizes of partitions are left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.python.filterPushdown.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and more; master only where none is set (tests, one machine)."""
    builder = SparkSession.builder.appName("areasignal").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once an application: they need not find it where the driver did."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_areasignal", None) is None:
        to = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
        with zipfile.ZipFile(to, "w") as made:
            for path in sorted(root.rglob("*.py")):
                made.write(path, path.relative_to(root.parent))
        context.addPyFile(to)
        context._areasignal = to


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one, but only if all of Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; the files go when the application ends."""
    spark, schema = df.sparkSession, df.schema
    to = f"{shared_folder(spark).rstrip('/')}/areasignal/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(to)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(schema).parquet(to)
