"""Windows over rows: persistence, running means, staggered grids, gaps and first occurrences.

Windows count rows, not days. They are partitioned by cell (or by grid row and
time), so no partition grows with more than one cell's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas import config
from nilas.functions import physics
from nilas.nulls import clip


def centred(keys: list[str], order: str, size: int):
    if size % 2 == 0:
        raise ValueError("a centred window needs an odd number of rows")
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size // 2), size // 2)


def binary_days(raw: str, keys: list[str], time: str, window: int = 11, least: int = 9) -> Column:
    """At least `least` hits among the rows around each row; the row's own state doesn't matter by itself."""
    return F.sum(F.col(raw).cast("int")).over(centred(keys, time, window)) >= least


def rolling_mean(value: str, keys: list[str], time: str, window: int = 15) -> Column:
    """Mean of a full window of known values, else NULL."""
    w = centred(keys, time, window)
    return F.when(F.count(value).over(w) == window, F.avg(value).over(w))


def padded(df: DataFrame, time: str, first: date, last: date, days: int) -> DataFrame:
    """Rows of a request and the days before and after that its windows need; crop when the windows are made."""
    return df.where((F.col(time) >= F.date_sub(F.lit(first), days)) & (F.col(time) <= F.date_add(F.lit(last), days)))


def smooth(value: str, keys: list[str], order: str, size: int) -> Column:
    return F.avg(value).over(centred(keys, order, size))


def circular_smooth(df: DataFrame, day: str, value: str, size: int, length: int = 365, keys: list[str] | None = None) -> DataFrame:
    """Running mean over the days of a year, the year's ends joined. Adds `smooth`."""
    half, keys = size // 2, keys or []
    around = centred(keys, "_at", size)
    ring = df.withColumn("_at", F.explode(F.array(F.col(day), F.col(day) - length, F.col(day) + length)))
    ring = ring.where((F.col("_at") > -half) & (F.col("_at") <= length + half))
    return ring.withColumn("smooth", F.avg(value).over(around)).where(F.col("_at") == F.col(day)).drop("_at")


def last_as_first(df: DataFrame, columns: list[str], keys: list[str], j: str = "nj", i: str = "ni") -> DataFrame:
    """The first column's values on the last column."""
    along = Window.partitionBy(*keys, j).orderBy(i)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(along) == F.count("*").over(Window.partitionBy(*keys, j))
    return df.withColumns({c: F.when(last, F.first(c).over(whole)).otherwise(F.col(c)) for c in columns})


def corner_to_centre(df: DataFrame, value: str, keys: list[str], j: str = "nj", i: str = "ni", wrap: bool = True, zero: bool = False) -> DataFrame:
    """Mean of the 2 x 2 corners of each cell. Adds `centre`: NULL on the last row, the first column's on the last column.

    Beside a missing corner it is NULL, or with `zero` that corner counts as 0.
    """
    along, up = Window.partitionBy(*keys, j).orderBy(i), Window.partitionBy(*keys, i).orderBy(j)
    v = F.coalesce(F.col(value), F.lit(0.0)) if zero else F.col(value)
    out = df.withColumn("_e", F.lead(v).over(along)).withColumns({"_n": F.lead(v).over(up), "_ne": F.lead("_e").over(up)})
    out = out.withColumn("centre", (v + F.col("_e") + F.col("_n") + F.col("_ne")) / 4).drop("_e", "_n", "_ne")
    return last_as_first(out, ["centre"], keys, j, i) if wrap else out


def edge_to_centre(df: DataFrame, value: str, keys: list[str], direction: str, j: str = "nj", i: str = "ni", wrap: bool = True, zero: bool = False) -> Column:
    """Mean of a cell's two edges: cyclic in x unless `wrap` is off, NULL on the last row in y. With `zero` a missing edge counts as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0)) if zero else F.col(value)
    along = Window.partitionBy(*keys, j).orderBy(i)
    if direction == "x" and wrap:
        whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = F.row_number().over(along) == F.count("*").over(Window.partitionBy(*keys, j))
        after = F.when(last, F.first(v).over(whole)).otherwise(F.lead(v).over(along))
    else:
        after = F.lead(v).over(along if direction == "x" else Window.partitionBy(*keys, i).orderBy(j))
    return (v + after) / 2


def enclosed_centres(df: DataFrame, value: str, keys: list[str], axes: str, j: str = "nj", i: str = "ni", wrap: bool = True, zero: bool = False) -> DataFrame:
    """Means at the centres of a field with one column ("x"), row ("y") or both ("xy", corners) more than there are centres: keys, j, i, `centre`.

    Each centre lies between its own line and the next, so none is missing at
    the end; with `wrap` the last column still takes the first one's values.
    """
    out = df.select(*keys, j, i, (F.coalesce(F.col(value), F.lit(0.0)) if zero else F.col(value)).alias("centre"))
    for axis in axes:
        at, across = (i, j) if axis == "x" else (j, i)
        w = Window.partitionBy(*keys, across).orderBy(at)
        out = out.withColumns({"_after": F.lead("centre").over(w), "_more": F.lead(at).over(w).isNotNull()})
        out = out.where("_more").select(*keys, j, i, ((F.col("centre") + F.col("_after")) / 2).alias("centre"))
    return last_as_first(out, ["centre"], keys, j, i) if wrap else out


def c_to_t(df: DataFrame, keys: list[str], names: tuple[str, str, str, str], combine: str = "mean", j: str = "nj", i: str = "ni", wrap: bool = True, zero: bool = True) -> DataFrame:
    """Adds `east` and `north` at the centres from uvelE, uvelN (averaged in x) and vvelE, vvelN (in y).

    'uv' takes uvelE and vvelN, 'mean' both families of edges.
    """
    if combine not in ("mean", "uv"):
        raise ValueError(f"unknown way to combine edges: {combine!r}")
    made = {f"_c{n}": edge_to_centre(df, c, keys, d, j, i, wrap, zero).cast("float") for n, (c, d) in enumerate(zip(names, "xxyy", strict=True))}
    out = df.withColumns(made)
    out = last_as_first(out, list(made), keys, j, i) if wrap else out
    ue, un, ve, vn = map(F.col, made)
    pair = (ue, vn) if combine == "uv" else ((ue + ve) / 2, (un + vn) / 2)
    return out.withColumns({"east": pair[0].cast("float"), "north": pair[1].cast("float")}).drop(*made)


def centre_speed(
    df: DataFrame, keys: list[str], grid_type: str | Iterable[str] | None = None, *, u: str = "uvel", v: str = "vvel",
    edges: tuple[str, str, str, str] = ("uvelE", "uvelN", "vvelE", "vvelN"), combine: str = "mean",
    regrid: Callable[[DataFrame, str], DataFrame] | None = None, j: str = "nj", i: str = "ni", wrap: bool = True,
) -> DataFrame:
    """Adds `speed` at the cell centres by one or more grid types; of several, the mean of those that are known.

    regrid: for Tx, makes keys, j, i and the named column at the centres from such a table of the B grid, missing values being 0.
    """
    chosen = config.grid_types(grid_type)
    needs = edges if "Tc" in chosen else (u, v)
    if missing := [c for c in needs if c not in df.columns]:
        raise KeyError(f"{', '.join(chosen)} needs columns that aren't there: {missing}")
    if "Tc" in chosen:
        out = c_to_t(df, keys, edges, combine, j, i, wrap)
        return out.withColumn("speed", physics.speed(F.col("east"), F.col("north"))).drop("east", "north")
    if "Tx" in chosen and regrid is None:
        raise NotImplementedError("Tx needs a regridder")
    out, speeds = df, []
    for t in chosen:
        for c, at in ((u, f"_{t}u"), (v, f"_{t}v")):
            if t == "Tx":
                made = regrid(df.select(*keys, j, i, F.coalesce(F.col(c), F.lit(0.0)).alias(c)), c)
                out = out.join(made.select(*keys, j, i, F.col(c).cast("float").alias(at)), [*keys, j, i], "left")
            else:
                out = corner_to_centre(out, c, keys, j, i, wrap, zero=t == "Tb").withColumn(at, F.col("centre").cast("float")).drop("centre")
        speeds.append(physics.speed(F.col(f"_{t}u"), F.col(f"_{t}v")))
    return out.withColumn("speed", (physics.mean_of_known(*speeds) if len(speeds) > 1 else speeds[0]).cast("float")).drop(*[f"_{t}{c}" for t in chosen for c in "uv"])


def edges(centre: str, keys: list[str], bounds: tuple[float, float] | None = None) -> tuple[Column, Column]:
    """Lower and upper edges halfway between centres, the ends extrapolated."""
    w = Window.partitionBy(*keys).orderBy(centre)
    x, before, after = F.col(centre), F.lag(centre).over(w), F.lead(centre).over(w)
    lo = F.coalesce((x + before) / 2, x - (after - x) / 2)
    hi = F.coalesce((x + after) / 2, x + (x - before) / 2)
    if bounds is None:
        return lo, hi
    return clip(lo, *bounds), clip(hi, *bounds)


def derived_masks(df: DataFrame, mask: str, j: str = "nj", i: str = "ni") -> DataFrame:
    """Edge and corner masks from cell masks: all adjoining cells are ocean. Cyclic in i, closed in j."""
    along, up = Window.partitionBy(j).orderBy(i), Window.partitionBy(i).orderBy(j)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(along) == F.count("*").over(Window.partitionBy(j))
    out = df.withColumn("_east", F.when(last, F.first(mask).over(whole)).otherwise(F.lead(mask).over(along)))
    out = out.withColumns({"_north": F.coalesce(F.lead(mask).over(up), F.lit(False)), "_ne": F.coalesce(F.lead("_east").over(up), F.lit(False))})
    m = F.col(mask)
    return out.withColumns({"emask": m & F.col("_east"), "nmask": m & F.col("_north"), "umask": m & F.col("_east") & F.col("_north") & F.col("_ne")}).drop(
        "_east", "_north", "_ne"
    )


def centred_difference(value: str, keys: list[str], order: str) -> Column:
    """Half the difference of both neighbours, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return F.coalesce((after - before) / 2, after - x, x - before)


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def duplicated(keys: list[Column]) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def daily_values(
    df: DataFrame, keys: list[str], time: str, value: str, first: date, last: date, how: str = "linear", max_gap: int = 35
) -> DataFrame:
    """Daily values between samples: linear or nearest, never beyond the samples, NULL farther than `max_gap` days from one."""
    days = df.select(*keys).distinct().withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))
    known = df.where(F.col(value).isNotNull()).select(*keys, time, F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    line = days.join(known, [*keys, time], "full")
    w = Window.partitionBy(*keys).orderBy(time)
    line = line.withColumn("_a", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_b", F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.datediff(time, "_a.t"), F.datediff(F.col("_b.t"), F.col(time))
    if how == "linear":
        v = F.when(back + ahead == 0, F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * back / F.nullif(back + ahead, F.lit(0)))
    else:
        v = F.when(back <= ahead, F.col("_a.v")).otherwise(F.col("_b.v"))
    v = F.when(F.least(back, ahead) <= max_gap, v)
    v = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), clip(v, 0.0, 1.0) if how == "linear" else v)
    return line.where(F.col(time).between(F.lit(first), F.lit(last))).select(*keys, time, v.alias(value))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """As-of join to the nearest row in time (the earlier of two as near). One sort of both tables, no range join."""
    rows = left.select(*keys, time, F.lit(None).cast(f"struct<t:date,v:{dict(right.dtypes)[value]}>").alias("_s")).withColumn("_left", F.lit(True))
    marks = right.select(*keys, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_s")).withColumn("_left", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(time)
    both = rows.unionByName(marks)
    both = both.withColumn("_a", F.last("_s", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("_b", F.first("_s", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    back, ahead = F.datediff(time, "_a.t"), F.datediff(F.col("_b.t"), F.col(time))
    near = F.when(F.col("_b").isNull() | (back <= ahead), F.col("_a")).otherwise(F.col("_b"))
    return both.where("_left").select(*keys, time, near["t"].alias("matched_time"), near["v"].alias(value))


def wrapped_values(df: DataFrame, day: str, value: str, length: int = 365) -> DataFrame:
    """Linear values of every day of a year between known days, across the new year too."""
    ring = df.where(F.col(value).isNotNull()).withColumn("_at", F.explode(F.array(F.col(day), F.col(day) - length, F.col(day) + length)))
    ring = ring.select("_at", F.struct(F.col("_at").alias("t"), F.col(value).alias("v")).alias("_s"))
    days = df.sparkSession.range(1, length + 1).select(F.col("id").cast("int").alias("_at")).withColumn("_day", F.lit(True))
    w = Window.orderBy("_at")  # a year of rows
    line = days.join(ring, "_at", "full").withColumn("_a", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_b", F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_day")
    share = F.try_divide(F.col("_at") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    return line.select(F.col("_at").alias(day), F.coalesce(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share, F.col("_a.v")).alias(value))


def dilated(df: DataFrame, mask: str, radius: int, j: str = "nj", i: str = "ni") -> DataFrame:
    """Adds `near`: a marked cell within `radius` rows and columns. Marked cells are spread, not all cells compared."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    marks = df.where(mask).select(j, i).withColumn(j, F.explode(F.transform(steps, lambda d: F.col(j) + d))).withColumn(i, F.explode(F.transform(steps, lambda d: F.col(i) + d)))
    return df.join(marks.distinct().withColumn("near", F.lit(True)), [j, i], "left").na.fill(False, ["near"])
