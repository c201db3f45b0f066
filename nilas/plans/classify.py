"""Classification: ice types of every cell and day by one of three methods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas import config
from nilas.operators import predicates as pred
from nilas.operators import windows


def classify(df: DataFrame, method: str, spec: config.Classification | None = None, *, keys: list[str] | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """df: time, keys, aice, speed and more. Adds fi, pi, si; crops to the days asked for after the windows are made.

    Binary days are not checked against the day's own concentration, so a cell
    can be fast on a day with little ice, and fast and pack ice needn't make up
    all ice then.
    """
    spec, keys, method = spec or config.Classification(), keys or ["cell"], config.method(method)
    if first is not None and last is not None:
        df = windows.padded(df, "time", first, last, spec.padding_days)
    aice = F.col("aice")
    raw = pred.fast_ice(aice, F.col("speed"), spec.concentration, spec.speed)
    if method == "raw":
        df = df.withColumn("fi", raw)
    elif method == "binary-days":
        df = df.withColumn("_raw", raw).withColumn("fi", F.coalesce(windows.binary_days("_raw", keys, "time", spec.window, spec.least), F.lit(False))).drop("_raw")
    else:
        df = df.withColumn("_mean", windows.rolling_mean("speed", keys, "time", spec.mean_window).cast("float"))
        df = df.withColumn("fi", pred.fast_ice(aice, F.col("_mean"), spec.concentration, spec.speed)).drop("_mean")
    df = df.withColumns({"pi": pred.pack_ice(aice, F.col("fi"), spec.concentration), "si": pred.sea_ice(aice, spec.concentration)})
    return df.where(F.col("time").between(F.lit(first), F.lit(last))) if first is not None and last is not None else df
