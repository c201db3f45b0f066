"""Queries that write to the shared folder and read back, and queries of readers, grids and names, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas import config
from nilas.functions import angles, calendar
from nilas.operators import predicates as pred
from nilas.operators import relational as rel
from nilas.operators import spatial, temporal
from nilas.plans import metrics
from nilas.plans.queries import C, query
from nilas.plans.surrogates import DAILY, POINTS, SERIES, STAGGERED, STATIONS, Tables
from nilas.sinks import tables as sinks
from nilas.sources import tables
from nilas.streaming import daily as streams

# --- history, classification and metric stores ------------------------------------------------------------------------


@query("SELECT ts AS time, CAST(user_id AS INTEGER) AS cell, value FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-01-17'")
def k02_s04_s05_hourly_store(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.ingest(t.read("events").select(C("ts").alias("time"), C("user_id").cast("int").alias("cell"), "value", "props"), root, frequency="hourly")
    return tables.history(t.spark, root, date(2024, 1, 10), date(2024, 1, 16), ["value"], frequency="inst").select("time", "cell", "value")


@query("""SELECT o_orderdate - INTERVAL 1 DAY AS time, o_orderkey AS cell, o_totalprice AS value, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m') AS ym FROM orders""")
def k01_k04_daily_store(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    rows = t.read("orders").select(C("o_orderdate").alias("time"), C("o_orderkey").alias("cell"), C("o_totalprice").alias("value"))
    sinks.ingest(rows.withColumn("value", C("value") + 1), root)
    sinks.ingest(rows, root)  # every group is there and is replaced
    return t.spark.read.parquet(root).select("time", "cell", "value", C("ym").cast("string").alias("ym"))


@query(f"WITH {DAILY} SELECT time, cell, aice FROM daily WHERE time BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND lat < -65")
def s02_s03_flat_store(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    d = t.daily()
    sinks.append(d.select("time", "cell", "aice", "hi"), root)
    grid = d.select("cell", (C("lat") + 65).alias("lat")).distinct()
    return tables.history(t.spark, root, date(2024, 1, 3), date(2024, 1, 20), ["aice"], grid=grid, hemisphere="south").select("time", "cell", "aice")


@query(f"WITH {DAILY} SELECT time, cell, fi, pi, si, FALSE AS again FROM masks")
def k07_s06_s08_classification_store(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    made = t.masks().withColumns({"method": F.lit("raw"), "grid_type": F.lit("Tb")})
    columns = ("time", "cell", "fi", "pi", "si", "method", "grid_type")
    sinks.classification(made, root, columns=columns)
    again = sinks.classification(made.limit(0), root, columns=columns)
    return tables.classified(t.spark, root, "Daily").select("time", "cell", "fi", "pi", "si", F.lit(again).alias("again"))


@query(f"WITH {DAILY} SELECT time, cell, si AS fi FROM masks")
def s09_first_method(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.by_kind(t.masks().select("time", "cell", C("si").alias("fi"), F.lit("rolling-mean").alias("method")), root, "method")
    return tables.first_method(t.spark, root, ["bin-days", "roll"]).select("time", "cell", "fi")


@query(f"""WITH {DAILY}, s AS (SELECT time, sum(area) AS a, sum(CASE WHEN fi THEN area ELSE 0 END) AS f FROM masks GROUP BY 1)
SELECT time, 'FIA' AS metric, f AS value FROM s WHERE time >= DATE '2024-01-12' UNION ALL SELECT time, 'SIA', a FROM s WHERE time >= DATE '2024-01-12'""")
def s07_k09_metric_store(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    one = lambda name, v: t.masks().groupBy("time").agg(F.sum(v).alias("value")).select("time", F.lit(name).alias("metric"), "value")
    sinks.metrics(one("FIA", F.when(C("fi"), C("area")).otherwise(0.0)), root)
    sinks.metrics(one("FIA", F.lit(1.0)).union(one("SIA", C("area"))), root)  # only SIA is new
    return tables.metrics(t.spark, root, ["FIA", "SIA"], date(2024, 1, 12), date(2030, 1, 1)).select("time", "metric", "value")


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders")
def k11_backup(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.append(t.read("orders").select(C("o_orderkey").alias("k"), C("o_totalprice").alias("v")), root)
    return t.spark.read.parquet(sinks.backup(t.spark, root))


@query(f"WITH {SERIES} SELECT time, v FROM series")
def k13_k19_csv_series(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.table(t.series(), root)
    return t.spark.read.option("header", True).schema("time date, v double").csv(root)


@query(f"WITH {DAILY} SELECT time, count(*) AS n, sum(area) AS area FROM daily GROUP BY 1")
def k14_t02_append(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    halves = t.daily().select("time", "cell", "area").withColumn("late", C("time") > F.lit(date(2024, 1, 15)))
    for late in (False, True):
        sinks.append(halves.where(C("late") == late).drop("late"), root)
    return t.spark.read.parquet(root).groupBy("time").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("SELECT vec_id AS station, len(embedding) AS bins, TRUE AS first, FALSE AS again, TRUE AS grown FROM embeddings")
def k15_t04_forcing(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    rows = t.read("embeddings").select(C("vec_id").alias("station"), F.size("embedding").cast("long").alias("bins"))
    n = rows.count()
    done = [sinks.forcing(rows.limit(1), root), sinks.forcing(rows, root, rows=1), sinks.forcing(rows, root, rows=n)]
    return t.spark.read.parquet(root).select("station", "bins", *[F.lit(d).alias(c) for d, c in zip(done, ("first", "again", "grown"), strict=True)])


@query(f"""WITH {POINTS} SELECT CASE WHEN lat < 0 THEN 'SH' ELSE 'NH' END AS hemisphere, i_type, count(*) AS n, avg(hi) AS hi, min(time) AS first, max(time) AS last FROM points GROUP BY 1, 2""")
def k18_points_by_kind(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.by_kind(t.points().withColumn("hemisphere", F.when(C("lat") < 0, "SH").otherwise("NH")), root, "hemisphere", "i_type")
    made = t.spark.read.parquet(root).groupBy("hemisphere", "i_type")
    return made.agg(F.count("*").alias("n"), F.avg("hi").alias("hi"), F.min("time").alias("first"), F.max("time").alias("last"))


@query("""SELECT user_id % 50 AS tgt_id, avg(value) AS value FROM events GROUP BY 1""")
def k20_stored_weights(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    cells = t.read("events").select((C("user_id") % 50).alias("tgt_id"), C("event_id").alias("src_id"), "value")
    sizes = cells.groupBy("tgt_id").agg(F.count("*").alias("n"))
    build = lambda: cells.join(sizes, "tgt_id").select("tgt_id", "src_id", (1 / C("n")).alias("w"))
    sinks.weights(t.spark, root, build)
    stored = sinks.weights(t.spark, root, lambda: build().limit(0))
    return stored.join(cells.drop("tgt_id"), "src_id").groupBy("tgt_id").agg(F.sum(C("w") * C("value")).alias("value"))


@query(f"WITH {STAGGERED} SELECT nj, ni, u AS ffx, v AS ffy, 0 AS problems, 2 AS problems_if_negative FROM staggered")
def g10_k17_factor_table(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.append(t.staggered().select("nj", "ni", C("u").alias("ffx"), C("v").alias("ffy")), root)
    made = t.spark.read.parquet(root)
    size = made.agg(F.max("nj") + 1, F.max("ni") + 1).first()
    good = sinks.factor_problems(made, shape=(size[1], size[0]))
    bad = sinks.factor_problems(made.withColumn("ffx", C("ffx") - 1), shape=(size[0], size[1] + 1))
    return made.select("nj", "ni", "ffx", "ffy", F.lit(len(good)).alias("problems"), F.lit(len(bad)).alias("problems_if_negative"))


# --- readers ----------------------------------------------------------------------------------------------------------


@query(f"WITH {DAILY} SELECT time, cell, aice, hi, CAST(aice AS DOUBLE) AS uvel FROM daily WHERE lat BETWEEN -90 AND 0 AND time >= DATE '2024-01-08' AND time < DATE '2024-01-15'")
def s15_reanalysis(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.append(t.daily().select("time", "cell", "lat", C("aice").alias("siconc"), C("hi").alias("sithick"), C("aice").cast("double").alias("uice"), "strength"), root)
    found = tables.product(t.spark, root, {"siconc": "aice", "sithick": "hi", "uice": "uvel"}, date(2024, 1, 8), date(2024, 1, 14))
    return found.where(pred.in_hemisphere_slice(C("lat"), "SH")).select("time", "cell", "aice", "hi", "uvel")


@query(f"WITH {SERIES} SELECT time, v AS sia FROM series WHERE time BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def s17_s20_ready_series(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.append(t.series().select("time", C("v").alias("SIA")), root)
    return tables.product(t.spark, root, {"SIA": "sia"}, date(1997, 1, 1), date(1998, 12, 31)).select("time", "sia")


@query(f"WITH {SERIES} SELECT time, v / 1e3 AS sia, v * 2 / 1e6 AS other FROM series WHERE time BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'")
def s30_area_series_by_units(t: Tables) -> DataFrame:
    root, days = sinks.scratch(t.spark), (date(1996, 2, 1), date(1997, 3, 31))
    sinks.append(t.series().select("time", C("v").alias("sea_ice_area"), (C("v") * 2).alias("other"), F.lit("10^3 km^2").alias("units")), root)
    own = tables.area_series(t.spark, root, first=days[0], last=days[1])
    other = tables.area_series(t.spark, root, variable="other", unit="km2", first=days[0], last=days[1])
    return own.join(other.withColumnRenamed("sia", "other"), "time")


@query(f"WITH {DAILY} SELECT time, cell, fi, TRUE AS first, FALSE AS again, TRUE AS forced FROM masks WHERE lat < -62")
def k08_native_mask(t: Tables) -> DataFrame:
    root, columns = sinks.scratch(t.spark), ("time", "cell", "fi")
    made = t.masks().where("lat < -62")
    done = [sinks.classification(made.limit(1), root, columns=columns), sinks.classification(made.limit(1), root, columns=columns)]
    done.append(sinks.classification(made, root, columns=columns, overwrite=True))
    return t.spark.read.parquet(root).select("*", *[F.lit(d).alias(c) for d, c in zip(done, ("first", "again", "forced"), strict=True)])


@query("""SELECT CAST(l_shipdate AS DATE) AS time, l_orderkey AS cell, l_linenumber AS code FROM lineitem WHERE l_shipdate >= DATE '1996-06-01' AND l_shipdate < DATE '1998-02-01'""")
def s19_s21_yearly_rasters(t: Tables) -> DataFrame:
    root, time = sinks.scratch(t.spark), C("l_shipdate").cast("date")
    sinks.by_kind(t.read("lineitem").select(time.alias("time"), C("l_orderkey").alias("cell"), C("l_linenumber").alias("code"), F.year(time).alias("year")), root, "year")
    return tables.yearly(t.spark, root, date(1996, 6, 1), date(1998, 1, 31), needs=("code",))


@query(f"""WITH {DAILY} SELECT time, cell, CASE WHEN isfinite(v) AND v > 0 THEN CAST(v AS REAL) END AS sit, CAST(NULL AS REAL) AS sic
FROM (SELECT *, CASE cell % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN hi - 2 WHEN 2 THEN 'Infinity'::DOUBLE ELSE hi END AS v FROM daily)
UNION ALL SELECT DATE '2024-01-15', cell, CASE WHEN hi > 0 THEN hi END, aice FROM daily""")
def s22_s23_sensor_files(t: Tables) -> DataFrame:
    d = t.daily()
    hi = C("hi").cast("double")
    odd = F.when(C("cell") % 4 == 0, float("nan")).when(C("cell") % 4 == 1, hi - 2).when(C("cell") % 4 == 2, float("inf")).otherwise(hi)
    timed = tables.sensor_thickness(d.select("time", "cell", odd.alias("sea_ice_thickness")))
    by_name = d.select("cell", C("hi").alias("analysis_sea_ice_thickness"), C("aice").alias("sea_ice_concentration"), F.lit("/cryosat/sit_20240115.nc").alias("path"))
    return timed.union(tables.sensor_thickness(by_name, C("path")))


@query("""SELECT source, count(*) AS n, sum(bin * CAST(e AS DOUBLE)) AS moment FROM (SELECT ['a', 'b', 'c'][s] AS source, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS bin
FROM embeddings, (SELECT unnest([1, 2, 3]) AS s)) GROUP BY 1""")
def s24_s25_union_of_sources(t: Tables) -> DataFrame:
    spectra = t.read("embeddings").select(C("vec_id").alias("seapoint"), F.posexplode("embedding").alias("bin", "Efth"))
    month = tables.renamed(spectra, {"seapoint": "station", "Efth": "efth"})
    whole = tables.union_sources({n: month for n in "abc"}, ["bin"])
    return whole.groupBy("source").agg(F.count("*").alias("n"), F.sum(C("bin") * C("efth").cast("double")).alias("moment"))


@query("""SELECT o_orderdate AS time, o_totalprice AS t2m FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-01'""")
def s26_k16_monthly_variable(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.ingest(t.read("orders").select(C("o_orderdate").alias("time"), C("o_totalprice").alias("2t"), "o_comment" if "o_comment" in t.read("orders").columns else C("o_orderstatus")), root, shift_days=0)
    return tables.product(t.spark, root, {"2t": "t2m"}, date(1997, 3, 1), date(1997, 3, 31)).select("time", "t2m")


@query("SELECT o_orderkey AS core_id, o_orderpriority AS i_type, o_totalprice / 50000 AS hi FROM orders")
def s27_f39_core_table(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    padded = F.encode(F.concat(F.lit("  "), C("o_orderpriority"), F.lit(" \x00\x00")), "UTF-8")
    sinks.append(t.read("orders").select(C("o_orderkey").alias("core_id"), padded.alias("i_type"), (C("o_totalprice") / 50000).alias("hi")), root)
    return t.spark.read.parquet(root).withColumn("i_type", tables.text(C("i_type")))


@query(f"WITH {STATIONS} SELECT CAST(src_id AS VARCHAR) AS id, lon, lat FROM stations WHERE lat <= -68")
def s28_icebergs(t: Tables) -> DataFrame:
    root = sinks.scratch(t.spark)
    sinks.table(t.stations().select(C("src_id").alias("ID"), C("lon").alias("Longitude"), C("lat").alias("Latitude")), root)
    return tables.icebergs(t.spark, root, -68.0)


@query(f"""WITH {STATIONS}, v AS (SELECT src_id % 25 AS feature, src_id % 2 AS part, src_id AS place, lon, lat FROM stations)
SELECT * FROM v WHERE (feature, part) IN (SELECT (feature, part) FROM v GROUP BY feature, part HAVING min(lat) <= -78)""")
def s29_polar_features(t: Tables) -> DataFrame:
    k = C("src_id")
    vertices = t.stations().select((k % 25).alias("feature"), (k % 2).alias("part"), k.alias("place"), "lon", "lat")
    return tables.polar_features(vertices, -78.0).select("feature", "part", "place", "lon", "lat")


@query("""SELECT o_custkey % 90 AS day, count(*) AS lines FROM orders GROUP BY 1""")
def x05_parser_per_file(t: Tables) -> DataFrame:
    import pandas as pd

    root = sinks.scratch(t.spark)
    t.read("orders").select((C("o_custkey") % 90).alias("day"), C("o_orderstatus")).repartition("day").write.partitionBy("day").option("header", False).csv(root)

    def parse(content: bytes, path: str) -> pd.DataFrame:
        return pd.DataFrame({"day": [int(path.split("day=")[1].split("/")[0])], "lines": [content.count(b"\n")]})

    return tables.through(t.spark, root, "*.csv", parse, "day long, lines long").groupBy("day").agg(F.sum("lines").alias("lines"))


# --- grids ------------------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS cell, s_acctbal AS depth, s_suppkey % 3 <> 0 AS ocean, s_acctbal > 0 AS ocean_by_depth FROM supplier""")
def s12_s10_k06_grid_bundle(t: Tables) -> DataFrame:
    s, root = t.read("supplier"), sinks.scratch(t.spark)
    static, depth = s.select(C("s_suppkey").alias("cell")), s.select(C("s_suppkey").alias("cell"), C("s_acctbal").alias("depth"))
    mask = s.where("s_suppkey % 3 <> 0").select(C("s_suppkey").alias("cell"), F.lit(True).alias("ocean"))
    sinks.append(tables.grid_bundle(static, mask, depth), root)
    return t.spark.read.parquet(root).join(tables.grid_bundle(static, None, depth).select("cell", C("ocean").alias("ocean_by_depth")), "cell")


CENTRES = """centres AS (SELECT CAST(j AS INTEGER) AS nj, CAST(i AS INTEGER) AS ni, 350.0::DOUBLE + i * 2 + j * 0.25 + a * 1e-4 AS lon, -70.0::DOUBLE + j + i * 0.125 + a * 1e-5 AS lat
  FROM (SELECT nj AS j, ni AS i, v AS a FROM staggered))"""
CORNERS = """corners AS (SELECT nj + a AS nj, ni + b AS ni, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon, avg(lat) AS lat
  FROM centres, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(a, b) GROUP BY 1, 2)"""


def mid(face: str, b: str) -> str:
    return f"SELECT '{face}' AS face, c.nj, c.ni, degrees(atan2((sin(radians(c.lon)) + sin(radians(d.lon))) / 2, (cos(radians(c.lon)) + cos(radians(d.lon))) / 2)) AS lon, (c.lat + d.lat) / 2 AS lat FROM corners c JOIN corners d ON {b}"


@query(f"""WITH {STAGGERED}, {CENTRES}, {CORNERS}, f AS ({mid('e', 'd.nj = c.nj + 1 AND d.ni = c.ni')} UNION ALL {mid('n', 'd.nj = c.nj AND d.ni = c.ni + 1')} UNION ALL SELECT 'corner', nj, ni, lon, lat FROM corners)
SELECT face, CAST(nj AS INTEGER) AS nj, CAST(ni AS INTEGER) AS ni, round((lon % 360 + 360) % 360, 9) AS lon, round(lat, 9) AS lat FROM f""")
def f33_grid_faces(t: Tables) -> DataFrame:
    j, i, a = C("nj"), C("ni"), C("v")
    centres = t.staggered().select("nj", "ni", (350 + i * 2 + j * 0.25 + a * 1e-4).alias("lon"), (-70 + j + i * 0.125 + a * 1e-5).alias("lat"))
    whole = spatial.grid_faces(centres).union(spatial.grid_corners(centres).select(F.lit("corner"), "nj", "ni", "lon", "lat"))
    return whole.select("face", j.cast("int").alias("nj"), i.cast("int").alias("ni"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


def unit(lon: str, lat: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lon})) AS ux, cos(radians({lat})) * sin(radians({lon})) AS uy, sin(radians({lat})) AS uz"


# On the ellipsoid's sphere of equal angles the pixels' latitudes come from the projection itself, so SQL takes them from the engine's formula.
RASTER = """raster AS (SELECT CAST(i AS DOUBLE) * 500000 - 3750000 AS x, CAST(j AS DOUBLE) * 500000 - 3750000 AS y FROM range(16) a(i), range(16) b(j)),
flat AS (SELECT x, y, degrees(atan2(x, y)) AS lon, pi() / 2 - 2 * atan(sqrt(x * x + y * y) / rho) AS chi, e FROM (SELECT *, sqrt(0.00669437999014) AS e,
  6378137.0 * cos(radians(71)) / sqrt(1 - 0.00669437999014 * sin(radians(71)) * sin(radians(71))) / (tan(pi() / 4 - radians(71) / 2) / pow((1 - sqrt(0.00669437999014) * sin(radians(71))) / (1 + sqrt(0.00669437999014) * sin(radians(71))), sqrt(0.00669437999014) / 2)) AS rho FROM raster)),
pix AS (SELECT x, y, lon, -degrees(chi + (e*e/2 + 5*pow(e,4)/24 + pow(e,6)/12 + 13*pow(e,8)/360) * sin(2*chi) + (7*pow(e,4)/48 + 29*pow(e,6)/240 + 811*pow(e,8)/11520) * sin(4*chi) + (7*pow(e,6)/120 + 81*pow(e,8)/1120) * sin(6*chi) + 4279*pow(e,8)/161280 * sin(8*chi)) AS lat FROM flat)"""


@query(f"""WITH {STATIONS}, {RASTER}, p AS (SELECT x, y, {unit('lon', 'lat')} FROM pix), s AS (SELECT src_id, value, {unit('lon + src_id * 1e-3', 'lat')} FROM stations),
d AS (SELECT x, y, src_id, value, 2 * 6371.0 * asin(least(sqrt(pow(p.ux - s.ux, 2) + pow(p.uy - s.uy, 2) + pow(p.uz - s.uz, 2)) / 2, 1.0)) AS km FROM p, s),
n AS (SELECT x, y, arg_min(value, km) AS value FROM d WHERE km <= 400 GROUP BY x, y) SELECT x, y, coalesce(n.value, -1.0) AS value FROM raster LEFT JOIN n USING (x, y)""")
def j16_g04_onto_raster(t: Tables) -> DataFrame:
    at = lambda c: C(c).cast("double") * 500000 - 3750000
    raster = t.spark.range(16).select(at("id").alias("x")).join(t.spark.range(16).select(at("id").alias("y")))
    sources = t.stations().withColumn("lon", C("lon") + C("src_id") * 1e-3)
    return spatial.onto_raster(sources, raster, 400.0, fill=-1.0).select("x", "y", "value")


@query(f"WITH {DAILY} SELECT time, cell, aice FROM daily, (SELECT max(cell) + 1 AS n FROM daily) WHERE CASE WHEN n % 2 = 0 THEN cell < n / 2 ELSE TRUE END")
def p28_best_half(t: Tables) -> DataFrame:
    n = t.daily().agg((F.max("cell") + 1).alias("n"))
    d = t.daily().join(F.broadcast(n)).withColumn("lat", F.when(C("cell") < C("n") / 2, -60.0).otherwise(60.0)).drop("n")
    return pred.best_half(d, "SH", j="cell").select("time", "cell", "aice")


@query(f"""WITH {STATIONS} SELECT src_id, lat <= -65 AND (lon >= 150 OR lon <= -120) AND src_id % 4 <> 0 AS inside FROM stations""")
def p13_sector(t: Tables) -> DataFrame:
    inside = pred.in_sector(C("lon"), C("lat"), (150.0, -120.0, -90.0, -65.0), "SH", C("src_id") % 4 != 0)
    return t.stations().select("src_id", inside.alias("inside"))


@query(f"""WITH {STATIONS} SELECT src_id, lon AS by_range, lat, CASE WHEN src_id % 2 = 0 THEN lon ELSE degrees(lon) END AS by_units FROM stations""")
def f10_angles(t: Tables) -> DataFrame:
    unit_of = F.when(C("src_id") % 2 == 0, "degrees_east").otherwise("Radians")
    s = t.stations().withColumns({"r": F.radians("lon"), "u": unit_of})
    greatest = s.agg(F.max(F.abs("r")).alias("gr"), F.max(F.abs("lat")).alias("gl"))
    s = s.join(F.broadcast(greatest))
    by_range, lat = angles.as_degrees(C("r"), C("gr")), angles.as_degrees(C("lat"), C("gl"))
    return s.select("src_id", F.round(by_range, 9).alias("by_range"), lat.alias("lat"), angles.as_degrees(C("lon"), C("gl"), C("u")).alias("by_units"))


# --- order and names --------------------------------------------------------------------------------------------------


@query(f"""WITH {SERIES}, y AS (SELECT year(time) AS y, max(v) AS most FROM series GROUP BY 1), r AS (SELECT CAST(y AS VARCHAR) AS period, most FROM y UNION ALL SELECT 'MEAN', avg(most) FROM y UNION ALL SELECT 'OVERALL', max(v) FROM series),
n AS (SELECT 'a' AS name, * FROM r UNION ALL SELECT 'b', * FROM r)
SELECT name, period, most AS max, CAST(row_number() OVER (ORDER BY name, TRY_CAST(period AS INTEGER) NULLS LAST, period) AS BIGINT) AS place FROM n""")
def o02_extrema_in_order(t: Tables) -> DataFrame:
    rows = temporal.extrema_rows({"b": t.series(), "a": t.series()})
    return rows.select("name", "period", "max").coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # a few rows a year


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(p_name || ' #' || p_brand || ' é/1.5 '), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS token,
['raw', 'bin-win-11_bin-min-09', 'roll-days-15', 'bin-win-11_bin-min-09'][p_partkey % 4 + 1] AS folder, ['raw', 'binary_days', 'rolling_mean', 'binary_days'][p_partkey % 4 + 1] AS slug, ['5.0e-4', '1.5e0', '2.0e-10', '1.0e3'][p_partkey % 4 + 1] AS tag, ['5e-4', '2e0', '2e-10', '1e3'][p_partkey % 4 + 1] AS compact FROM part""")
def f42_names(t: Tables) -> DataFrame:
    names, numbers = (" Daily", "bin", "roll-mean", "BIN-DAYS"), (5e-4, 1.5, 2e-10, 1e3)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (C("p_partkey") % 4).cast("int"))
    cls = config.Classification()
    return t.read("part").select(
        "p_partkey", rel.file_token(F.concat("p_name", F.lit(" #"), "p_brand", F.lit(" é/1.5 "))).alias("token"),
        pick([config.method_folder(n, cls) for n in names]).alias("folder"), pick(list(map(config.method_slug, names))).alias("slug"),
        pick([config.threshold_tag(v) for v in numbers]).alias("tag"), pick([config.threshold_tag(v, 0) for v in numbers]).alias("compact"),
    )


@query("""WITH n(name, place) AS (VALUES ('SIA', 1), ('FIA', 2), ('FIV', 3), ('FIT', 4), ('FIP', 5), ('FIS', 6), ('FITVR', 7), ('FIMVR', 8), ('FITAR', 9), ('FIMAR', 10))
SELECT e.event_type AS kind, n.name, CAST(n.place AS BIGINT) AS place, n.name IN ('FIV', 'FIT', 'FIS') AS hi, n.name = 'FITVR' AS dvidtt FROM (SELECT DISTINCT event_type FROM events) e, n""")
def p29_p30_names_and_columns(t: Tables) -> DataFrame:
    names = config.metric_names(("SIA", "FIA"), ("F:core", "F:core"))
    kinds = t.read("events").select(C("event_type").alias("kind")).distinct()
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("hi" in metrics.needed([n])).alias("hi"), F.lit("dvidtt" in metrics.needed([n])).alias("dvidtt")) for n in names])
    return kinds.select("kind", F.posexplode(listed).alias("place", "n")).select("kind", "n.name", (C("place") + 1).cast("long").alias("place"), "n.hi", "n.dvidtt")


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS day, event_id, value FROM events")
def t01_replaced_groups(t: Tables) -> DataFrame:
    source, out, marks = (sinks.scratch(t.spark) for _ in range(3))
    rows = t.read("events").select(C("ts").cast("date").alias("day"), "event_id", "value")
    schema = rows.schema
    for value in (C("value") - 1, C("value")):  # what comes later replaces its days
        sinks.append(rows.withColumn("value", value), source)
        streams.replace_groups(t.spark.readStream.schema(schema).parquet(source), out, marks, "day").awaitTermination()
    return t.spark.read.parquet(out).select(C("day").cast("date").alias("day"), "event_id", "value")


@query(f"""WITH {DAILY}, w AS (SELECT time, cell, coalesce(sum(CAST(fi AS INTEGER)) OVER (PARTITION BY cell ORDER BY time ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) >= 9, FALSE) AS persistent FROM masks)
SELECT time, cell, persistent FROM w WHERE time <= DATE '2024-01-30' - 5""")
def t06_settled_rows(t: Tables) -> DataFrame:
    return streams.settled(t.masks().select("time", "cell", "fi"), ["cell"], "time", "fi", date(2024, 1, 30)).select("time", "cell", "persistent")


@query("""SELECT 's' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '_' || strftime(o_orderdate, '%Y%m%d') || '.nc' AS path, CAST(o_orderdate AS DATE) AS day FROM orders
QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1""")
def s16_s18_o06_file_of_each_day(t: Tables) -> DataFrame:
    o = t.read("orders")
    name = F.concat(F.lit("s"), F.lpad(C("o_orderkey").cast("string"), 8, "0"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".nc"))
    listing = o.select(name.alias("path"), F.regexp_extract(name, r"_(\d{8})", 0).alias("stamp")).select("path", calendar.date_in_name(C("stamp")).alias("date"))
    first, last = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    return tables.one_per_day(listing, first.date(), last.date()).where(C("path").isNotNull()).select("path", C("date").alias("day"))
