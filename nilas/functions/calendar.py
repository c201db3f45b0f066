"""Days, seasons and dates in names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noleap_day(time: Column) -> Column:
    """Day of a year without 29 February (1 to 365); that day itself has none."""
    leap = (F.month(time) == 2) & (F.dayofmonth(time) == 29)
    return F.when(~leap, F.dayofyear(F.make_date(F.lit(2001), F.month(time), F.when(leap, 28).otherwise(F.dayofmonth(time)))))


def antarctic_year(time: Column) -> Column:
    """March to February, named by the year of its March."""
    return F.when(F.month(time) >= 3, F.year(time)).otherwise(F.year(time) - 1)


def season_year(time: Column, first_month: int) -> Column:
    """Seasons that cross the new year are named by the year they start in."""
    return F.when(F.month(time) >= first_month, F.year(time)).otherwise(F.year(time) - 1)


def date_in_name(path: Column) -> Column:
    """The eight-digit date of a file name, or the fifteenth of its six-digit month."""
    name = F.element_at(F.split(path, "/"), -1)
    day, month = F.regexp_extract(name, r"(\d{8})", 1), F.regexp_extract(name, r"(\d{6})", 1)
    digits = F.when(day != "", day).when(month != "", F.concat(month, F.lit("15")))
    return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")


def date_or_day(text: Column, year: Column, day: Column) -> Column:
    """yyyymmdd text, or else a year and a day of it."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1))


def sensor_in_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("cryosat"), "cryosat2").when(low.contains("envisat"), "envisat").when(low.contains("sentinel"), "sentinel3").otherwise("unknown")
