"""Units as data: every conversion reads a units column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nilas.nulls import clip


def _clean(units: Column) -> Column:
    return F.lower(F.trim(units))


def thickness_rate_m_day(value: Column, units: Column) -> Column:
    """Metres a day; unknown units are taken for centimetres a day."""
    u = F.regexp_replace(F.lower(units), r"\s", "")
    return F.when(u.isin("m/day", "mday-1", "md-1"), value).when(u.isin("m/s", "ms-1"), value * 86400.0).otherwise(value / 100.0)


def _square(units: Column) -> Column:
    """One spelling of area units: km² , km**2 and km^2 are km2, 10^3 is 1e3, and blanks and stars go."""
    u = F.replace(F.replace(F.lower(units), F.lit("²"), F.lit("2")), F.lit("^"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(u, r"[\s*]", ""), "^10(?=[36])", "1e")


def area_million_km2(value: Column, units: Column) -> Column:
    """Millions of square kilometres; unknown units are an error."""
    u = _square(units)
    known = F.when(u == "m2", value / 1e12).when(u == "km2", value / 1e6).when(u == "1e3km2", value / 1e3).when(u == "1e6km2", value)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown area units: "), units)).cast("double"))


def area_m2(value: Column, units: Column) -> Column:
    return F.when(_square(units) == "km2", value * 1e6).otherwise(value)


def length_m(value: Column, units: Column) -> Column:
    """Metres; unknown units are taken for metres."""
    return F.when(_clean(units) == "cm", value / 100.0).when(_clean(units) == "km", value * 1000.0).otherwise(value)


def fraction(value: Column, units: Column, greatest: Column) -> Column:
    """0 to 1: percent by units, or where the greatest value is beyond 1.5."""
    percent = F.coalesce(_clean(units).isin("%", "percent"), F.lit(False)) | (greatest > 1.5)
    return clip(F.when(percent, value / 100.0).otherwise(value), 0.0, 1.0)


def area_from_cm2(value: Column, mean: Column) -> Column:
    """Areas whose mean is beyond 1e11 are square centimetres."""
    return F.when(mean > 1e11, value / 1e4).otherwise(value)


def gigabytes(text: Column) -> Column:
    """'512mb' and the like as GB."""
    n = F.regexp_extract(F.lower(text), r"^\s*([0-9.]+)\s*([kmgt]?)b?\s*$", 1)
    unit = F.regexp_extract(F.lower(text), r"^\s*([0-9.]+)\s*([kmgt]?)b?\s*$", 2)
    size = F.when(n != "", n).cast("double")
    power = F.when(unit == "k", 2).when(unit == "m", 1).when(unit == "g", 0).when(unit == "t", -1).otherwise(3)
    return size / F.pow(F.lit(1024.0), power)


def seconds(text: Column) -> Column:
    """HH:MM:SS as seconds."""
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def clock(total: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)
