"""Climatologies, extrema, slopes and seasons of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.functions.calendar import antarctic_year, noleap_day, season_year

WINTER = (5, 6, 7, 8, 9, 10)


def first_max(time: Column, value: Column) -> Column:
    """Aggregate: the first time of the greatest value."""
    return F.max_by(time, F.struct(value, -F.unix_date(time)))


def first_min(time: Column, value: Column) -> Column:
    return F.min_by(time, F.struct(value, F.unix_date(time)))


def slope(time: Column, value: Column) -> Column:
    """Aggregate: least-squares change per day, NULL for fewer than two days."""
    x = F.unix_date(time).cast("double")
    return F.when(F.min(F.when(value.isNotNull(), x)) < F.max(F.when(value.isNotNull(), x)), F.regr_slope(value.cast("double"), x))


def yearly_extrema(df: DataFrame, time: str, value: str, keys: list[str], antarctic: bool = False) -> DataFrame:
    t, v = F.col(time), F.col(value)
    year = antarctic_year(t) if antarctic else F.year(t)
    known = df.where(v.isNotNull()).withColumn("year", year)
    return known.groupBy(*keys, "year").agg(
        F.max(v).alias("max"), F.min(v).alias("min"), F.dayofyear(first_max(t, v)).alias("doy_max"), F.dayofyear(first_min(t, v)).alias("doy_min")
    )


def seasonal_summary(df: DataFrame, time: str, value: str, keys: list[str]) -> DataFrame:
    """Mean and spread over the years of each year's extrema and their days."""
    years = yearly_extrema(df, time, value, keys)
    aggs = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in ("max", "min", "doy_max", "doy_min") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return years.groupBy(*keys).agg(*aggs)


def extrema_table(df: DataFrame, time: str, value: str, antarctic: bool = False) -> DataFrame:
    """Extrema of each year, a MEAN row over them, and an OVERALL row."""
    years = yearly_extrema(df, time, value, [], antarctic)
    t, v = F.col(time), F.col(value)
    overall = df.agg(F.max(v).alias("max"), F.min(v).alias("min"), F.dayofyear(first_max(t, v)).alias("doy_max"), F.dayofyear(first_min(t, v)).alias("doy_min"))
    mean = years.agg(*[F.avg(c).alias(c) for c in ("max", "min", "doy_max", "doy_min")])
    columns = ["period", "max", "min", "doy_max", "doy_min"]

    def shaped(part: DataFrame, name: Column) -> DataFrame:
        return part.withColumn("period", name).select("period", *[F.col(c).cast("double").alias(c) for c in columns[1:]])

    return shaped(years, F.col("year").cast("string")).union(shaped(mean, F.lit("MEAN"))).union(shaped(overall, F.lit("OVERALL")))


def extrema_rows(tables: dict[str, DataFrame], antarctic: bool = False) -> DataFrame:
    """Extrema tables of several series (name: time, v), by name; years in order, then MEAN and OVERALL."""
    parts = [extrema_table(d, "time", "v", antarctic).withColumn("name", F.lit(n)) for n, d in tables.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.withColumn("year_start", F.when(F.col("period").rlike("^[0-9]{4}"), F.substring("period", 1, 4)).cast("int"))
    return whole.orderBy("name", F.col("year_start").asc_nulls_last(), "period")


def season_slopes(df: DataFrame, time: str, value: str, keys: list[str], months: tuple[int, ...], least: int = 20) -> DataFrame:
    """Per season: points, first and last value, change per day. Seasons of too few points or months are left out."""
    t, v = F.col(time), F.col(value)
    part = df.where(F.month(t).isin(*months) & v.isNotNull()).withColumn("season_year", season_year(t, months[0]))
    out = part.groupBy(*keys, "season_year").agg(
        F.count("*").alias("n"), F.count_distinct(F.month(t)).alias("_m"), F.min_by(v, t).alias("start_value"), F.max_by(v, t).alias("end_value"), slope(t, v).alias("slope")
    )
    return out.where((F.col("n") >= least) & (F.col("_m") == len(months))).drop("_m")


def statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, maximum, minimum and 95th percentile, one row each."""
    v = F.col(value).cast("double")
    wide = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.percentile(v, 0.95).alias("p95"))
    return wide.unpivot(keys, ["mean", "max", "min", "p95"], "statistic", "value")


def stability(df: DataFrame, mask: str, time: str, cell: str, area: str, months: tuple[int, ...] = WINTER, limit: float = 0.8) -> DataFrame:
    """Area that is ice on most winter days, area that ever is, and their ratio."""
    cells = df.where(F.month(time).isin(*months)).groupBy(cell, area).agg(F.avg(F.col(mask).cast("double")).alias("_m"))
    p, e = F.coalesce(F.sum(F.when(F.col("_m") >= limit, F.col(area))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("_m") > 0, F.col(area))), F.lit(0.0))
    return cells.agg(p.alias("persistent_area"), e.alias("ever_area")).withColumn("index", F.when(F.col("ever_area") > 0, F.col("persistent_area") / F.col("ever_area")))


def daily_envelope(df: DataFrame, time: str, value: str, how: str = "minmax", noleap: bool = True) -> DataFrame:
    """Mean and envelope of each day of the year, all 365 days there."""
    day = noleap_day(F.col(time)) if noleap else F.least(F.dayofyear(time), F.lit(365))
    v = F.col(value).cast("double")
    lo, hi = {
        "minmax": (F.min(v), F.max(v)),
        "std": (F.avg(v) - F.stddev_samp(v), F.avg(v) + F.stddev_samp(v)),
        "p10p90": (F.percentile(v, 0.1), F.percentile(v, 0.9)),
    }[how]
    found = df.withColumn("doy", day).where(F.col("doy").isNotNull()).groupBy("doy").agg(F.avg(v).alias("mean"), lo.alias("lo"), hi.alias("hi"), F.count(v).alias("n"))
    days = df.sparkSession.range(1, 366).select(F.col("id").cast("int").alias("doy"))
    return days.join(found, "doy", "left").na.fill(0, ["n"])


def monthly_climatology(df: DataFrame, time: str, value: str) -> DataFrame:
    """Monthly means, then mean, extremes and number of years of each calendar month, all twelve there."""
    months = df.groupBy(F.trunc(time, "MM").alias("_m")).agg(F.avg(value).alias("_v"))
    found = months.groupBy(F.month("_m").alias("month")).agg(F.avg("_v").alias("mean"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n"))
    return df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month")).join(found, "month", "left").na.fill(0, ["n"])


def resample(df: DataFrame, time: str, value: str, unit: str) -> DataFrame:
    """Means of calendar months or years; periods without rows between the first and last are there and NULL."""
    step = "month" if unit == "month" else "year"
    found = df.groupBy(F.date_trunc(step, time).cast("date").alias("period")).agg(F.avg(value).alias("mean"))
    ends = found.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b", F.make_interval(years=F.lit(int(step == "year")), months=F.lit(int(step == "month"))))).alias("period"))
    return every.join(found, "period", "left")


def repeat_climatology(days: DataFrame, climatology: DataFrame, time: str, day: str) -> DataFrame:
    """The climatology's value of each day; day 366 takes day 365's."""
    return days.withColumn(day, F.least(F.dayofyear(time), F.lit(365))).join(climatology, day, "left")


def keep_first(df: DataFrame, time: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(time).orderBy(*order))).where("_n = 1").drop("_n")
