"""Ice types, boxes and time slices as boolean columns."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.functions.angles import lon180
from nilas.nulls import lit32


def fast_ice(aice: Column, speed: Column, concentration: float = 0.15, limit: float = 5e-4) -> Column:
    """Enough ice that moves, but hardly; compared in single precision, never NULL."""
    return F.coalesce((aice > lit32(concentration)) & (speed > 0) & (speed <= lit32(limit)), F.lit(False))


def sea_ice(aice: Column, concentration: float = 0.15) -> Column:
    return F.coalesce(aice >= lit32(concentration), F.lit(False))


def pack_ice(aice: Column, fast: Column, concentration: float = 0.15, inclusive: bool = False) -> Column:
    """Ice that isn't fast. Model classes exclude the threshold itself, reanalysis classes include it."""
    over = aice >= lit32(concentration) if inclusive else aice > lit32(concentration)
    return F.coalesce(over & ~fast, F.lit(False))


def masked(value: Column, mask: Column, fill: float | None = None) -> Column:
    """NULL (for means) or a number (for sums) where the mask doesn't hold."""
    kept = F.when(mask, value)
    return kept if fill is None else kept.otherwise(F.lit(fill))


def in_hemisphere(lat: Column, name: str) -> Column:
    """Strict: the equator is in neither."""
    return lat < 0 if name == "SH" else lat > 0


def in_hemisphere_slice(lat: Column, name: str) -> Column:
    """Inclusive, for one-dimensional latitudes."""
    return lat.between(-90, 0) if name == "SH" else lat.between(0, 90)


def in_days(time: Column, first: date, last: date) -> Column:
    """A date as an end means that whole day."""
    return (time >= F.lit(first)) & (time < F.date_add(F.lit(last), 1))


def until_instant(time: Column, first: datetime, last: datetime) -> Column:
    """A timestamp as an end means that instant."""
    return (time >= F.lit(first)) & (time <= F.lit(last))


def overlap_slice(df: DataFrame, time: str, first: date, last: date) -> DataFrame:
    """The overlap of a request and the table's own range; nothing if there is none."""
    if last < first:
        raise ValueError("the slice ends before it starts")
    ends = df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return (
        df.join(F.broadcast(ends))  # one row
        .where((F.col(time) >= F.greatest("_lo", F.lit(first))) & (F.col(time) <= F.least("_hi", F.lit(last))))
        .drop("_lo", "_hi")
    )


def in_box(lon: Column, lat: Column, lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> Column:
    """Edges included; a box whose western edge is greater wraps around the date line."""
    x = lon180(lon)
    across = F.when(lon_min <= lon_max, x.between(lon_min, lon_max)).otherwise((x >= lon_min) | (x <= lon_max))
    return across & lat.between(lat_min, lat_max)


def open_water(sic: Column, limit: float) -> Column:
    return F.coalesce(sic < limit, F.lit(False))


def trim_edges(df: DataFrame, time: str, days: int) -> DataFrame:
    """Without the first and last days of a series."""
    ends = df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    inside = (F.col(time) >= F.date_add("_lo", days)) & (F.col(time) <= F.date_sub(F.col("_hi"), days))
    return df.join(F.broadcast(ends)).where(inside).drop("_lo", "_hi")


def not_leap_day(time: Column) -> Column:
    return ~((F.month(time) == 2) & (F.dayofmonth(time) == 29))


def mobility(df: DataFrame, speed_mean: str, speed_max: str, fraction: str, limit: float, near: float = 2.0, share: float = 0.1) -> DataFrame:
    """Daily classes of hourly movement: immobile, near, hidden (mean below, maximum above) and pulsed (seldom above)."""
    m, x, f = F.col(speed_mean), F.col(speed_max), F.col(fraction)
    return df.withColumns(
        {
            "immobile": x <= limit,
            "near": (m > limit) & (m <= near * limit),
            "hidden": (m <= limit) & (x > limit),
            "pulsed": (x > limit) & (f <= share),
        }
    )


def polar(lat: Column, name: str, limit: float) -> Column:
    """Poleward of a latitude limit, which is included."""
    return lat <= -abs(limit) if name == "SH" else lat >= abs(limit)


def in_months(time: Column, months: tuple[int, ...]) -> Column:
    return F.month(time).isin(*months)


def at_least(category: Column, least: float) -> Column:
    """1.0 where a category is reached, else 0.0; missing ones are 0.0."""
    return F.when(category >= least, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")


def triples(df: DataFrame, lon: str, lat: str, value: str, drop_zero: bool = False) -> DataFrame:
    """A field as lon, lat and value of its finite points, without zeros if asked."""
    v = F.col(value)
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(fine & (v != 0) if drop_zero else fine).select(F.col(lon).alias("lon"), F.col(lat).alias("lat"), v.alias("value"))


def in_sector(lon: Column, lat: Column, box: tuple[float, float, float, float], hemisphere: str | None = "SH", ocean: Column | None = None) -> Column:
    """Within a box (lon_min, lon_max, lat_min, lat_max), edges and the equator included, and on ocean cells where a mask is given."""
    inside = in_box(lon, lat, *map(F.lit, box))
    if hemisphere is not None:
        inside &= in_hemisphere_slice(lat, hemisphere)
    return inside if ocean is None else inside & F.coalesce(ocean, F.lit(False))


def best_half(df: DataFrame, hemisphere: str, j: str = "nj", lat: str = "lat", value: str = "aice", time: str = "time") -> DataFrame:
    """The half of a grid's rows that lies in a hemisphere, or all of it.

    Halves score by their share of cells in the hemisphere, and a twentieth of
    their share of cells with a value on the first day; a half is taken if half
    of it at least lies there and it scores more than the other one.
    """
    rows = df.agg((F.max(j) + 1).alias("_rows"), F.min(time).alias("_first"))
    half = F.when(F.col(j) < F.col("_rows") / 2, 0).otherwise(1)
    there, known = in_hemisphere(F.col(lat), hemisphere).cast("double"), F.when(F.col(time) == F.col("_first"), F.col(value).isNotNull().cast("double"))
    halved = df.join(F.broadcast(rows)).withColumn("_half", half)  # one row
    score = halved.groupBy("_half").agg(F.avg(there).alias("_hemi"), F.first("_rows").alias("_n"), F.coalesce(F.avg(known), F.lit(0.0)).alias("_known"))
    total = F.col("_hemi") + 0.05 * F.col("_known")
    one = score.agg(
        F.max_by("_half", total).alias("_best"), F.max_by("_hemi", total).alias("_h"), F.max(total).alias("_t"), F.min(total).alias("_o"), F.max("_n").alias("_all")
    )
    crop = (F.col("_all") >= 2) & (F.col("_all") % 2 == 0) & (F.col("_h") >= 0.5) & (F.col("_t") > F.col("_o"))
    return halved.join(F.broadcast(one)).where(~crop | (F.col("_half") == F.col("_best"))).select(df.columns)
