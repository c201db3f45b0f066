"""Readers. Every one is a plan with partition and column pruning; nothing is listed or opened on the driver's disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas import config
from nilas.functions import calendar, units
from nilas.nulls import nan_to_null
from nilas.operators import predicates as pred
from nilas.operators import relational as rel


def history(
    spark: SparkSession,
    root: str,
    first: date,
    last: date,
    columns: list[str] | None = None,
    *,
    frequency: str = "daily",
    grid: DataFrame | None = None,
    hemisphere: str | None = None,
    pad_days: int = 0,
) -> DataFrame:
    """Rows of whole days; partitions `ym` of the frequency's months or days that are outside are never read, those of another frequency are.

    A grid is joined by its cell, then cut to a hemisphere.
    """
    form = config.STORES[config.frequency(frequency)]
    a, b = first - timedelta(days=pad_days), last + timedelta(days=pad_days)
    df = spark.read.parquet(root)
    if "ym" in df.columns:
        ym, lo, hi = F.col("ym").cast("string"), a.strftime(form), b.strftime(form)
        df = df.where(F.col("ym").isNotNull() & (ym.between(lo, hi) | (F.length(ym) != len(lo))))
    df = nan_to_null(df.where(pred.in_days(F.col("time"), a, b)))
    if columns is not None:
        df = df.select(*[c for c in df.columns if c in {"time", "nj", "ni", "cell", "sim", *columns}])
    if grid is not None:
        df = df.join(grid, [c for c in ("nj", "ni", "cell") if c in df.columns and c in grid.columns])
        if hemisphere is not None:
            df = df.where(pred.in_hemisphere(F.col("lat"), config.hemisphere(hemisphere)))
    return df


def values_of(spark: SparkSession, root: str, column: str) -> list[str]:
    """The values of a store's column: the names of its folders where it is partitioned by it, else those in its rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for depth in range(4):
        if found := files.globStatus(path("/".join([root, *["*=*"] * depth, f"{column}=*"]))):
            return sorted({x.getPath().getName().partition("=")[2] for x in found})
    return sorted(r[0] for r in spark.read.parquet(root).select(column).distinct().collect())


def classified(spark: SparkSession, root: str, method: str, *, grid_type: str | None = None, order: tuple[str, ...] = ("Tb", "Tc")) -> DataFrame:
    """A classification; its grid type is the wanted one or the only one there."""
    df = spark.read.parquet(root).where(F.col("method") == config.method(method))
    return df.where(F.col("grid_type") == rel.resolve(values_of(spark, root, "grid_type"), order, grid_type))


def first_method(spark: SparkSession, root: str, methods: list[str]) -> DataFrame:
    """The one method of several candidates that is there."""
    return spark.read.parquet(root).where(F.col("method") == rel.resolve(values_of(spark, root, "method"), tuple(map(config.method, methods))))


def product(spark: SparkSession, root: str, names: dict[str, str] | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """A ready series or raster product by its canonical names, in days of a range if one is given."""
    df = renamed(spark.read.parquet(root), names or {})
    return df if first is None else df.where(pred.in_days(F.col("time"), first, last))


#: The names that an area series goes by, in order of preference.
AREA_SERIES = ("SIA", "sia", "sea_ice_area")


def area_series(
    spark: SparkSession, root: str, *, variable: str | None = None, candidates: tuple[str, ...] = AREA_SERIES, unit: str | None = None,
    first: date | None = None, last: date | None = None,
) -> DataFrame:
    """time and sia (millions of square kilometres) of a stored series, by its `units` column or the units given. None in the range is an error."""
    df = spark.read.parquet(root)
    name = variable or next((c for c in candidates if c in df.columns), None)
    if name not in df.columns:
        raise LookupError(f"{name or ' or '.join(candidates)} not among {df.columns}")
    if first is not None:
        df = df.where(F.col("time") >= F.lit(first))
    if last is not None:
        df = df.where(F.col("time") < F.date_add(F.lit(last), 1))
    if df.isEmpty():
        raise LookupError(f"no row between {first or 'the start'} and {last or 'the end'}")
    unit = F.lit(unit) if unit is not None else F.col("units")
    return df.select("time", units.area_million_km2(F.col(name).cast("double"), unit).alias("sia"))


def yearly(spark: SparkSession, root: str, first: date, last: date, needs: tuple[str, ...] = ()) -> DataFrame:
    """Rasters that are stored by `year`: only the years of the range are read. A needed column that isn't there is an error."""
    df = spark.read.parquet(root)
    if missing := [c for c in needs if c not in df.columns]:
        raise LookupError(f"{', '.join(missing)} not among {df.columns}")
    return df.where(F.col("year").between(first.year, last.year) & pred.in_days(F.col("time"), first, last)).drop("year")


#: The names that thickness and concentration go by in sensor files, in order of preference.
THICKNESS = ("sea_ice_thickness", "sithick", "sit", "thickness")
CONCENTRATION = ("sea_ice_concentration", "sea_ice_area_fraction", "siconc", "sic")


def sensor_thickness(df: DataFrame, path: Column | None = None) -> DataFrame:
    """A sensor's rows as time, cell, sit (finite and positive, else NULL) and sic (NULL where there is none); the time is the file's where the rows have none."""
    sit = F.col(first_present(df, list(THICKNESS))).cast("float")
    try:
        sic = F.col(first_present(df, list(CONCENTRATION))).cast("float")
    except LookupError:
        sic = F.lit(None).cast("float")
    time = F.col("time") if "time" in df.columns else calendar.date_in_name(path)
    valid = (sit > 0) & ~F.isnan(sit) & (sit < float("inf"))
    return df.select(time.cast("date").alias("time"), "cell", F.when(valid, sit).alias("sit"), sic.alias("sic"))


def union_sources(parts: dict[str, DataFrame], axes: list[str], name: str = "source") -> DataFrame:
    """All sources under one name column. Sources whose axes hold other values than the first one's are an error."""
    whole = rel.stack(parts, name)
    for axis in axes:
        found = whole.groupBy(name).agg(F.array_sort(F.collect_set(axis)).alias("_a")).select(name, F.hash("_a").alias("_h")).collect()  # a row per source
        if len({r["_h"] for r in found}) > 1:
            raise ValueError(f"sources differ in {axis}")
    return whole


def grid_bundle(static: DataFrame, mask: DataFrame | None = None, bathymetry: DataFrame | None = None, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """A grid's cells with their ocean mask and depth; where no mask is given, cells of positive depth are ocean."""
    out = static
    if bathymetry is not None:
        out = out.join(bathymetry.select(*keys, "depth"), list(keys), "left")
    if mask is not None:
        return out.join(mask.select(*keys, "ocean"), list(keys), "left").na.fill({"ocean": False})
    return out.withColumn("ocean", F.coalesce(F.col("depth") > 0, F.lit(False))) if bathymetry is not None else out


def icebergs(spark: SparkSession, root: str, limit: float = -60.0) -> DataFrame:
    """Grounded icebergs from CSV files with a header: id, lon and lat under any of their usual spellings, south of a limit."""
    df = spark.read.option("header", True).csv(root)
    lon, lat = (F.col(first_present(df, [n, n.upper(), f"{n}gitude" if n == "lon" else f"{n}itude"])).cast("double") for n in ("lon", "lat"))
    return df.select(F.col(first_present(df, ["id", "name"])).alias("id"), lon.alias("lon"), lat.alias("lat")).where(lat <= limit)


def polar_features(vertices: DataFrame, limit: float = -50.0) -> DataFrame:
    """The vertices of features (feature, part, place, lon, lat) that have one at or beyond a latitude."""
    kept = vertices.groupBy("feature", "part").agg(F.min("lat").alias("_l")).where(F.col("_l") <= limit)
    return vertices.join(kept.select("feature", "part"), ["feature", "part"], "left_semi")


def text(value: Column) -> Column:
    """Byte strings as text, without the blanks and zero bytes around it."""
    return F.btrim(F.decode(value, "UTF-8"), F.lit(" \t\n\r\x00"))


def metrics(spark: SparkSession, root: str, names: list[str], first: date, last: date) -> DataFrame:
    df = spark.read.parquet(root).where(F.col("metric").isin(names))
    return pred.overlap_slice(df, "time", first, last)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their canonical names: {'siconc': 'aice'} and so on; missing ones are left out."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that is a column, else the first that one contains."""
    for c in candidates:
        if c in df.columns:
            return c
    for c in candidates:
        if found := [x for x in df.columns if c.lower() in x.lower()]:
            return found[0]
    raise LookupError(f"none of {candidates} is a column")


def concentration_series(df: DataFrame, area: str = "area") -> DataFrame:
    """A table's own area series, or the one made from its concentrations."""
    if "sia" in df.columns:
        return df.select("time", "sia")
    name = first_present(df, ["aice", "siconc", "sic", "conc"])
    greatest = df.agg(F.max(name).alias("_g"))
    sic = units.fraction(F.col(name).cast("double"), F.lit(None).cast("string"), F.col("_g"))
    return df.join(F.broadcast(greatest)).groupBy("time").agg((F.coalesce(F.sum(sic * F.col(area)), F.lit(0.0)) / 1e12).alias("sia"))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size, time of change, date and sensor of files, recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.col("path")
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), calendar.date_in_name(path).alias("date"), calendar.sensor_in_path(path).alias("sensor"))


def one_per_day(listing: DataFrame, first: date, last: date) -> DataFrame:
    """The first file of each day of a range; days without one have NULL."""
    days = listing.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    return days.join(listing.groupBy("date").agg(F.min("path").alias("path")), "date", "left")


def through(spark: SparkSession, root: str, pattern: str, parse: Callable[[bytes, str], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that `parse` makes from each file's bytes: the door for formats that Spark doesn't read (NetCDF, Zarr chunks)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield parse(content, path)

    return found.mapInPandas(run, schema)


def netcdf(spark: SparkSession, root: str, columns: list[str], schema: str) -> DataFrame:
    """One-dimensional NetCDF variables as rows, where a NetCDF library is installed."""
    try:
        import netCDF4  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs the netCDF4 package; convert to Parquet instead") from e

    def parse(content: bytes, path: str) -> pd.DataFrame:
        import netCDF4

        with netCDF4.Dataset(path, memory=content) as ds:
            return pd.DataFrame({c: ds[c][:].filled(float("nan")).ravel() for c in columns})

    return through(spark, root, "*.nc", parse, schema)


def key_values(texts: DataFrame, text: str = "value") -> DataFrame:
    """key = value lines of whole texts (namelists, diagnostics)."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\w+\s*=\s*.*$"), F.lit(0))
    out = texts.withColumn("_p", F.explode(pairs))
    return out.select(*[c for c in texts.columns if c != text], F.trim(F.split("_p", "=", 2)[0]).alias("key"), F.trim(F.split("_p", "=", 2)[1]).alias("value"))


def usage_reports(texts: DataFrame, text: str = "value") -> DataFrame:
    """Fields of batch usage reports."""
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return texts.select(
        get(r"(?i)job id:\s*(\S+)").alias("job"), get(r"(?i)project:\s*(\S+)").alias("project"), get(r"(?i)exit status:\s*(-?\d+)").cast("int").alias("exit_status"),
        get(r"(?i)service units:\s*([0-9.]+)").cast("double").alias("service_units"), units.gigabytes(get(r"(?i)memory used:\s*([0-9.]+\s*[kmgt]?b)")).alias("memory_gb"),
        units.seconds(get(r"(?i)walltime used:\s*([0-9:]+)")).alias("wall_s"),
    )
