"""Resuming as a stream: each run takes what came since the last one, and appends keys that aren't there yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areasignal.sources.records import append_new


def resume(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Runs to the end of what is there. Files read before aren't read again; a batch that is repeated after a failure adds
    nothing, as its keys are there."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    query = rows.writeStream.foreachBatch(lambda df, _: append_new(df.dropDuplicates(list(keys)), target, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def failed(attempts: DataFrame, key: str, order: Sequence[str], error: str) -> DataFrame:
    """key and error of the keys whose last attempt by order had one."""
    last = attempts.groupBy(key).agg(F.max(F.struct(*order, error)).alias("_r"))
    return last.select(key, F.col(f"_r.{error}").alias(error)).where(F.col(error).isNotNull())


def windowed_counts(rows: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by window and kind of a stream (or a table), late rows taken up to the watermark."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", kind, "n")
