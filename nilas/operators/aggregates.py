"""Metrics as grouped aggregates; each takes columns and gives columns, so that many share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.nulls import ratio, zsum
from nilas.operators.predicates import in_box


#: Rows that are broadcast without a second thought.
FEW = 10_000


def area(mask: Column, sic: Column, cell: Column, scale: float = 1e9) -> Column:
    return zsum(F.when(mask, sic).otherwise(0.0) * cell) / scale


def volume(mask: Column, sic: Column, hi: Column, cell: Column, scale: float = 1e12) -> Column:
    return zsum(F.when(mask, sic * hi).otherwise(0.0) * cell) / scale


def thickness(mask: Column, sic: Column, hi: Column, cell: Column) -> Column:
    """Area-weighted; cells of unknown thickness count in the divisor only."""
    ice = F.when(mask, sic)
    return ratio(zsum(ice * hi * cell), zsum(ice * cell))


def strength(mask: Column, strength: Column, sic: Column, hi: Column, cell: Column) -> Column:
    """Mean of strength over thickness in MPa, where both are known."""
    field = F.when(mask & (hi > 0), strength / hi / 1e6)
    return ratio(zsum(field * sic * cell), zsum(F.when(field.isNotNull(), sic * cell)))


def persistence(mask: Column, percent: bool = True) -> Column:
    return F.avg(mask.cast("double")) * (100.0 if percent else 1.0)


def volume_rate(mask: Column, rate_m_day: Column, sic: Column, cell: Column) -> Column:
    return zsum(F.when(mask, rate_m_day * sic).otherwise(0.0) * cell)


def area_rate(mask: Column, tendency: Column, cell: Column) -> Column:
    return zsum(F.when(mask, tendency).otherwise(0.0) * cell)


def mean_rate(mask: Column, rate_m_day: Column, cell: Column | None = None) -> Column:
    field = F.when(mask, rate_m_day)
    return F.avg(field if cell is None else field * cell)


def weighted_mean(mask: Column, value: Column, weight: Column, absolute: bool = False) -> Column:
    v = F.abs(value) if absolute else value
    return ratio(zsum(F.when(mask, v * weight)), valid_area(mask, value, weight))


def valid_area(mask: Column, value: Column, weight: Column) -> Column:
    return zsum(F.when(mask & value.isNotNull(), weight))


def extent(sic: Column, cell: Column, limit: float = 0.15, scale: float = 1e12) -> tuple[Column, Column]:
    """Area and extent above a concentration."""
    return zsum(F.when(sic >= limit, sic * cell)) / scale, zsum(F.when(sic >= limit, cell)) / scale


def skill(model: Column, obs: Column) -> dict[str, Column]:
    """Bias, RMSE, MAE and correlation where both are known; no correlation with a constant."""
    known = model.isNotNull() & obs.isNotNull()
    m, o = F.when(known, model.cast("double")), F.when(known, obs.cast("double"))
    d = m - o
    varies = (F.min(m) < F.max(m)) & (F.min(o) < F.max(o))
    cov, spread = F.avg(m * o) - F.avg(m) * F.avg(o), F.stddev_pop(m) * F.stddev_pop(o)
    return {"bias": F.avg(d), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "corr": F.when(varies, F.try_divide(cov, spread))}


def with_regions(df: DataFrame, boxes: DataFrame, lon: str, lat: str) -> DataFrame:
    """Range join to named boxes: inclusive edges, so a cell can be in two or none.

    Boxes are broadcast up to FEW; more are left to the planner.
    """
    b = F.broadcast(boxes) if boxes.limit(FEW + 1).count() <= FEW else boxes
    return df.join(b, in_box(F.col(lon), F.col(lat), b["lon_min"], b["lon_max"], b["lat_min"], b["lat_max"]))


def composite(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, spread and number of the members that have a value."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def agreement_by_region(df: DataFrame, model: str, obs: str, cell: str, keys: list[str]) -> DataFrame:
    """Overlap and excess areas of two persistence fields, and their shares."""
    m, o, a = F.col(model), F.col(obs), F.col(cell)
    return (
        df.where(m.isNotNull() & o.isNotNull())
        .groupBy(*keys)
        .agg(
            zsum(F.least(m, o) * a).alias("overlap"),
            zsum(F.greatest(m - o, F.lit(0.0)) * a).alias("model_excess"),
            zsum(F.greatest(o - m, F.lit(0.0)) * a).alias("obs_excess"),
        )
        .withColumn("_all", F.col("overlap") + F.col("model_excess") + F.col("obs_excess"))
        .select(*keys, "overlap", "model_excess", "obs_excess", *[(100 * ratio(F.col(c), F.col("_all"))).alias(f"{c}_pct") for c in ("overlap", "model_excess", "obs_excess")])
    )


def hourly_to_daily(df: DataFrame, keys: list[str], u: str, v: str, limit: float) -> DataFrame:
    """Daily movement from hourly components."""
    s = F.hypot(u, v)
    out = df.groupBy(*keys).agg(
        F.avg(u).alias("u_mean"), F.avg(v).alias("v_mean"), F.avg(s).alias("speed_mean"), F.sqrt(F.avg(s * s)).alias("speed_rms"),
        F.max(s).alias("speed_max"), F.avg((s > limit).cast("double")).alias("mobile_fraction"), F.bool_or(s > limit).alias("any_mobile"),
    )
    return out.withColumn("vector_speed", F.hypot("u_mean", "v_mean"))


def health(df: DataFrame, expected: list[str]) -> DataFrame:
    """Per expected column: there, number of values, all missing."""
    have = set(df.columns)
    row = df.agg(*[(F.count(c) if c in have else F.lit(0)).cast("long").alias(c) for c in expected], F.count("*").alias("_rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), F.col(c).alias("n")) for c in expected])
    return row.select(F.inline(pairs), "_rows").select("column", "present", "n", ((F.col("n") == 0) & (F.col("_rows") > 0)).alias("all_missing"))
