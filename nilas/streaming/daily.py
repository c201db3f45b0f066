"""Streams of observations: daily groups behind a watermark, incremental ingest, and windows that wait for their future rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nilas.operators import windows


def daily_groups(stream: DataFrame, time: str, keys: list[str], value: str, late: str = "2 days") -> DataFrame:
    """Count, sum and extremes of each day and key; a day is final when the watermark has passed it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("_w"), *keys)
    out = w.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("_w.start").alias("day"), *keys, "n", "total", "least", "most")


def replace_groups(stream: DataFrame, root: str, checkpoint: str, group: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Write all that is new and stop; each micro-batch replaces the groups it holds, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        prepare(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(root)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(history: DataFrame, keys: list[str], time: str, raw: str, newest, size: int = 11, least: int = 9) -> DataFrame:
    """Persistence of the rows whose window can't change any more: `size // 2` days before the newest day that is complete."""
    out = history.withColumn("persistent", windows.binary_days(raw, keys, time, size, least))
    return out.where(F.col(time) <= F.date_sub(F.lit(newest), size // 2))
