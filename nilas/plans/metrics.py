"""The metric catalogue: named metrics of the three domains, all of one rank in one pass over the classified table.

A name is a domain letter (F fast, P pack, S sea ice) and a metric: FIA, PIT,
SIKuxE_mean, FI_tau_air_mean and so on; persistent_winter_area and
ever_winter_area are of fast ice. Sea ice takes its mask for area, maps, stress
and diagnostics only. A metric whose columns aren't there is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas import config
from nilas.functions import physics, units
from nilas.operators import aggregates as agg
from nilas.operators import temporal

MASKS = {"F": "fi", "P": "pi", "S": "si"}
UNITS = {"IA": "1e3 km2", "IV": "1e3 km3", "IT": "m", "IS": "MPa", "ITVR": "m3/day", "IMVR": "m3/day", "ITAR": "m2/day", "IMAR": "m2/day", "IP": "%", "IHI": "m", "IST": "N/m"}
UNITS |= {n: "m2" if n.endswith("_m2") else "Pa" for n in config.STRESS} | {f"I_{n}_mean": "Pa" for n in (*physics.STRESSES, "tau_ld_est")}
UNITS |= {"I_ice_speed_mean": "m/s", "I_rel_ice_ocean_speed_mean": "m/s", "I_R_ld_budget_mean": "1", "I_P_ld_est_mean": "W/m2"}
UNITS |= {n[1:]: "1e3 km2" for n in ("persistent_winter_area", "ever_winter_area")} | {"IPSI": "1"}
RATES = {"ITVR": "dvidtt", "IMVR": "dvidtd", "ITAR": "daidtt", "IMAR": "daidtd"}


def stress_parts(what: str) -> tuple[list[str], str, str]:
    """IKuxE_abs_mean: its components, its edge's area and its statistic."""
    base = next(what.removesuffix(f"_{s}") for s in ("abs_mean", "valid_area_m2", "mean") if what.endswith(f"_{s}"))
    edge = base.removesuffix("_mag")[-1]
    return [f"Kux{edge}", f"Kuy{edge}"] if base.endswith("_mag") else [base[1:]], f"{edge.lower()}area", what.removeprefix(f"{base}_")


def stress_metric(name: str, have: set[str]) -> Column:
    """Area-weighted mean, absolute mean or valid area of an edge's stress or its magnitude; the cell's area where the edge's isn't known."""
    parts, weight, statistic = stress_parts(name[1:])
    if missing := [c for c in parts if c not in have]:
        raise ValueError(f"{name} needs columns that aren't there: {', '.join(missing)}")
    mask, area = F.col(MASKS[name[0]]), F.col(weight if weight in have else "area")
    values = [F.col(c).cast("double") for c in parts]
    value = F.hypot(*values) if len(values) == 2 else values[0]
    if statistic == "valid_area_m2":
        return agg.valid_area(mask, value, area)
    return agg.weighted_mean(mask, value, area, absolute=statistic == "abs_mean")


def thickness_rate(column: str, have: set[str]) -> Column:
    """Metres a day by the units that the column <name>_units holds; centimetres a day where there is none."""
    return units.thickness_rate_m_day(F.col(column), F.col(f"{column}_units") if f"{column}_units" in have else F.lit("cm/day"))


def series_metric(name: str, have: set[str] = frozenset()) -> Column:
    """The aggregate of a time series metric; `have` are the table's columns."""
    domain, what = name[0], name[1:]
    own, aice, hi, area = F.col(MASKS[domain]), F.col("aice"), F.col("hi"), F.col("area")
    mask = F.lit(True) if domain == "S" else own
    if what == "IA":
        return agg.area(own, aice, area)
    if what == "IV":
        return agg.volume(mask, aice, hi, area)
    if what == "IT":
        return agg.thickness(mask, aice, hi, area)
    if what == "IS":
        return agg.strength(mask, F.col("strength"), aice, hi, area)
    if what in ("ITVR", "IMVR"):
        return agg.volume_rate(mask, thickness_rate(RATES[what], have), aice, area)
    if what in ("ITAR", "IMAR"):
        return agg.area_rate(mask, F.col(RATES[what]), area)
    if what in config.STRESS:
        return stress_metric(name, have)
    if what in config.DIAGS:
        return agg.weighted_mean(own, physics.diagnostic(what[2:].removesuffix("_mean"), have), area)
    raise ValueError(f"unknown metric: {name!r}")


def map_metric(name: str, have: set[str] = frozenset()) -> Column:
    """The aggregate of a metric per cell."""
    domain, what = name[0], name[1:]
    mask = F.col(MASKS[domain])
    if what == "IP":
        return agg.persistence(mask)
    if what in ("IHI", "IST"):
        return F.avg(F.when(mask, F.col({"IHI": "hi", "IST": "strength"}[what])))
    rate = RATES.get(what.removesuffix("_YR"))
    if rate and what.endswith("_YR"):
        return agg.mean_rate(mask, thickness_rate(rate, have), F.col("area") if "AR" in what else None)
    raise ValueError(f"unknown metric: {name!r}")


def ranks(names: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """Names by rank: series, maps, regional series, scalars."""
    config.by_domain(names)
    out: tuple[list[str], ...] = ([], [], [], [])
    for n in names:
        what = n[1:]
        rank = 2 if what in config.REGIONAL else 3 if what in config.SUMMARY or n in config.SPECIFIC else 1 if what == "IP" or what in config.SPATIAL else 0
        out[rank].append(n)
    return out


def needed(names: list[str]) -> list[str]:
    """Columns that the metrics read besides keys, masks and area."""
    uses = {"IV": ["hi"], "IT": ["hi"], "IS": ["hi", "strength"], "IHI": ["hi"], "IST": ["strength"]}

    def columns(name: str) -> list[str]:
        what = name[1:]
        if what in config.STRESS:
            parts, weight, _ = stress_parts(what)
            return [*parts, weight]
        if what in config.DIAGS:
            return physics.diagnostic_inputs(what[2:].removesuffix("_mean"))
        key = what[:2] if what in config.SUMMARY or name in config.SKILL else what.removesuffix("_by_region")
        return uses.get(key, [RATES[key.removesuffix("_YR")]] if key.removesuffix("_YR") in RATES else [])

    return list(dict.fromkeys(["aice", *[c for n in names for c in columns(n)]]))


def long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(UNITS.get(n[1:])).cast("string").alias("units")) for n in names])
    return df.select(*keys, F.inline(cells))


def stability(df: DataFrame, names: list[str], cell: str) -> DataFrame:
    """One row of the winter's persistence: NULL where the table has no winter day."""
    winter = temporal.stability(df, "fi", "time", cell, "area")
    some = winter.join(df.agg(F.bool_or(F.month("time").isin(*temporal.WINTER)).alias("_any")))
    made = {"FIPSI": F.col("index"), "persistent_winter_area": F.col("persistent_area") / 1e9, "ever_winter_area": F.col("ever_area") / 1e9}
    return some.select(*[F.when(F.col("_any"), made[n]).alias(n) for n in names])


def compute(
    df: DataFrame, names: list[str], cell: str = "cell", regions: DataFrame | None = None, obs: DataFrame | None = None,
    calculators: dict[str, Callable[[set[str]], Column]] | None = None,
) -> DataFrame:
    """metric, time, region, cell, value and units; what a metric's rank lacks is NULL.

    obs: time and the observed FIA and FIT that skill is asked of. calculators:
    time series metrics by name, which add to the catalogue's or take the place
    of one, also where summaries and skill are made from it; each gives the
    aggregate from the names of the table's columns.
    """
    given = calculators or {}
    series, maps, regional, scalars = ranks([n for n in names if n not in given])
    series = [*[n for n in names if n in given], *series]
    parts: list[DataFrame] = []
    steady, skilled = [n for n in scalars if n in config.STABILITY], [n for n in scalars if n in config.SKILL]
    scalars = [n for n in scalars if n not in config.SPECIFIC]
    parents = list(dict.fromkeys([*series, *[n[:3] for n in (*scalars, *skilled)]]))
    have = set(df.columns)
    by_time = df.groupBy("time").agg(*[(given[n](have) if n in given else series_metric(n, have)).alias(n) for n in parents]) if parents else None
    if series:
        parts.append(long(by_time, ["time"], series))
    if maps:
        parts.append(long(df.groupBy(cell).agg(*[map_metric(n, have).alias(n) for n in maps]), [cell], maps))
    if regional:
        if regions is None:
            raise ValueError("regional metrics need regions")
        boxed = agg.with_regions(df, regions, "lon", "lat")
        made = boxed.groupBy("time", "region").agg(*[series_metric(n.removesuffix("_by_region"), have).alias(n) for n in regional])
        parts.append(long(made, ["time", "region"], regional))
    for parent in dict.fromkeys(n[:3] for n in scalars):
        mine = [n for n in scalars if n.startswith(parent)]
        summary = temporal.seasonal_summary(by_time.select("time", parent, F.lit(parent).alias("_k")), "time", parent, ["_k"])
        parts.append(long(summary.select(*[F.col(n[4:]).alias(n) for n in mine]), [], mine))
    if steady:
        parts.append(long(stability(df, steady, cell), [], steady))
    for parent in dict.fromkeys(n[:3] for n in skilled):
        if obs is None or parent not in obs.columns:
            raise ValueError(f"skill of {parent} needs observations of it")
        mine = [n for n in skilled if n.startswith(parent)]
        pair = by_time.select("time", F.col(parent).alias("m")).join(obs.select("time", F.col(parent).alias("o")), "time")
        skill = agg.skill(F.col("m"), F.col("o"))
        parts.append(long(pair.agg(*[skill[n[4:].lower()].alias(n) for n in mine]), [], mine))
    if not parts:
        raise ValueError("no metric is asked for")
    columns = {"time": "date", "region": "string", cell: df.schema[cell].dataType.simpleString()}

    def shaped(p: DataFrame) -> DataFrame:
        return p.select("metric", *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], "value", "units")

    return reduce(DataFrame.unionByName, map(shaped, parts))
