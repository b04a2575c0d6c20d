"""What the operators of this subpackage share: lineage cuts and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.session import shared_folder, ship


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with the package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Rows that a file of a table of known size has at least, where tasks don't have more.
ROWS_A_FILE = 4096


def written(df: DataFrame, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    narrow: rows are few bytes of what was read, so they are dealt into files of the planner's advisory size first; else a
    scan of texts in many tasks would leave as many tiny files. rows: no more than so many are written, so shuffles into many
    partitions leave no more files than that needs. The files are marked for deletion when the application ends.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    spark = df.sparkSession
    to = f"{shared_folder(spark).rstrip('/')}/areasignal/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    (df.hint("rebalance") if narrow else df).write.parquet(to)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(schema).parquet(to)


def in_fold(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 0 modulo 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def kind_of(df: DataFrame, col: str) -> str:
    """A column's type as DDL text."""
    return df.schema[col].dataType.simpleString()
