"""Missing values and single-precision thresholds, settled once at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so that comparisons and aggregates skip it."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("float", "double")})


def lit32(value: float) -> Column:
    """A threshold in single precision: single-precision columns are compared without widening."""
    return F.lit(value).cast("float")


def zsum(value: Column) -> Column:
    """A sum that is 0 where nothing is there to add."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def ratio(above: Column, below: Column) -> Column:
    """NULL unless the divisor is positive."""
    return F.when(below > 0, above / below)


def clip(value: Column, low: float, high: float) -> Column:
    """Within the bounds; NULL stays NULL (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
