"""Gridded tables made from the general test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.config import REGIONS
from nilas.operators.predicates import fast_ice, pack_ice, sea_ice

SPEED = 8e-4


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def daily(self) -> DataFrame:
        """One row per day and cell."""
        v = F.col("value")
        u = F.col("user_id")
        return (
            self.read("events")
            .groupBy(F.col("ts").cast("date").alias("time"), "user_id")
            .agg(F.avg(v).alias("m"), F.max(v).alias("x"), F.count("*").alias("n"))
            .select(
                "time", u.cast("int").alias("cell"), F.least(F.col("m") / 100, F.lit(1.0)).cast("float").alias("aice"), (F.col("m") / 1e5).cast("float").alias("speed"),
                F.when(u % 11 != 0, F.col("x") / 50).cast("float").alias("hi"), (F.col("x") * 1000).cast("float").alias("strength"),
                ((F.col("m") - 50) / 10).cast("float").alias("rate"), ((F.col("x") - 100) / 1000).cast("float").alias("tend"),
                (F.lit(1e6) * (1 + u % 7)).alias("area"), ((u * 37) % 360 - 180).cast("double").alias("lon"), (-60 - u % 20).cast("double").alias("lat"),
            )
        )

    def masks(self) -> DataFrame:
        d = self.daily().withColumn("fi", fast_ice(F.col("aice"), F.col("speed"), limit=SPEED))
        return d.withColumns({"pi": pack_ice(F.col("aice"), F.col("fi")), "si": sea_ice(F.col("aice"))})

    def series(self) -> DataFrame:
        return self.read("lineitem").groupBy(F.col("l_shipdate").cast("date").alias("time")).agg((F.sum("l_extendedprice") / 1e6).alias("v"))

    def flags(self) -> DataFrame:
        """Series of two regions."""
        return self.read("lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_shipdate").cast("date").alias("time")).agg((F.sum("l_extendedprice") / 1e6).alias("v"))

    def typed(self, kind: str) -> DataFrame:
        e = self.read("events").where(F.col("event_type") == kind)
        return e.groupBy(F.col("ts").cast("date").alias("time")).agg(F.avg("value").alias("v"))

    def hourly(self) -> DataFrame:
        e = self.read("events")
        h = F.date_trunc("hour", "ts")
        return e.groupBy(F.col("ts").cast("date").alias("day"), h.alias("hour"), (F.col("user_id") % 10).alias("cell")).agg(
            (F.avg("value") / 1e5).alias("u"), ((F.max("value") - 60) / 1e5).alias("v")
        )

    def regions(self) -> DataFrame:
        rows = [*REGIONS, ("WRAP", 170.0, -170.0, -80.0, -60.0)]
        values = ", ".join(f"('{n}', {a}D, {b}D, {c}D, {d}D)" for n, a, b, c, d in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t(region, lon_min, lon_max, lat_min, lat_max)")

    def staggered(self) -> DataFrame:
        r = self.read("lineitem").groupBy((F.col("l_suppkey") % 10).cast("int").alias("nj"), (F.col("l_partkey") % 12).cast("int").alias("ni"))
        return r.agg(F.avg("l_discount").alias("u"), F.avg("l_tax").alias("v"))

    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("src_id"), ((k * 37) % 360 - 180).cast("double").alias("lon"), (-60 - k % 20).cast("double").alias("lat"), F.col("s_acctbal").alias("value"))

    def targets(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(k.alias("tgt_id"), ((k * 53) % 360 - 180).cast("double").alias("lon"), (-60 - k % 25).cast("double").alias("lat"))

    def spectra(self) -> DataFrame:
        e = self.read("embeddings").select(F.col("vec_id").alias("station"), F.posexplode("embedding").alias("bin", "e"))
        return e.select("station", "bin", F.abs(F.col("e").cast("double")).alias("e"), (0.04 + 0.01 * F.col("bin")).alias("f"))

    def points(self) -> DataFrame:
        o = self.read("orders")
        return o.select(
            F.col("o_orderkey").alias("core_id"), F.col("o_orderstatus").alias("cruise"), F.col("o_orderdate").cast("date").alias("time"),
            (F.col("o_custkey") % 90 - 90).cast("double").alias("lat"), ((F.col("o_custkey") * 7) % 360 - 180).cast("double").alias("lon"),
            (F.col("o_totalprice") / 50000).alias("hi"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice") / 500000).alias("hs"),
            F.col("o_orderpriority").alias("i_type"),
        )


BOXES = "boxes(region, lon_min, lon_max, lat_min, lat_max) AS (VALUES " + ", ".join(
    f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in [*REGIONS, ("WRAP", 170.0, -170.0, -80.0, -60.0)]
) + ")"
DAILY = f"""daily AS (
  SELECT CAST(ts AS DATE) AS time, CAST(user_id AS INTEGER) AS cell, CAST(least(avg(value) / 100, 1.0) AS REAL) AS aice,
    CAST(avg(value) / 1e5 AS REAL) AS speed, CAST(CASE WHEN user_id % 11 <> 0 THEN max(value) / 50 END AS REAL) AS hi,
    CAST(max(value) * 1000 AS REAL) AS strength, CAST((avg(value) - 50) / 10 AS REAL) AS rate, CAST((max(value) - 100) / 1000 AS REAL) AS tend,
    1e6 * (1 + user_id % 7) AS area, CAST((user_id * 37) % 360 - 180 AS DOUBLE) AS lon, CAST(-60 - user_id % 20 AS DOUBLE) AS lat
  FROM events GROUP BY CAST(ts AS DATE), user_id
), fimask AS (SELECT *, aice > 0.15::REAL AND speed > 0 AND speed <= {SPEED}::REAL AS fi FROM daily
), masks AS (SELECT *, aice > 0.15::REAL AND NOT fi AS pi, aice >= 0.15::REAL AS si FROM fimask)"""
SERIES = "series AS (SELECT CAST(l_shipdate AS DATE) AS time, sum(l_extendedprice) / 1e6 AS v FROM lineitem GROUP BY 1)"
FLAGS = "flags AS (SELECT l_returnflag AS region, CAST(l_shipdate AS DATE) AS time, sum(l_extendedprice) / 1e6 AS v FROM lineitem GROUP BY 1, 2)"
STAGGERED = """staggered AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS nj, CAST(l_partkey % 12 AS INTEGER) AS ni, avg(l_discount) AS u, avg(l_tax) AS v
  FROM lineitem GROUP BY 1, 2)"""
STATIONS = """stations AS (SELECT s_suppkey AS src_id, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST(-60 - s_suppkey % 20 AS DOUBLE) AS lat,
  s_acctbal AS value FROM supplier), targets AS (SELECT c_custkey AS tgt_id, CAST((c_custkey * 53) % 360 - 180 AS DOUBLE) AS lon,
  CAST(-60 - c_custkey % 25 AS DOUBLE) AS lat FROM customer)"""
SPECTRA = """bins AS (SELECT vec_id AS station, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings),
spectra AS (SELECT station, CAST(bin AS INTEGER) AS bin, abs(CAST(e AS DOUBLE)) AS e, 0.04::DOUBLE + 0.01::DOUBLE * bin AS f FROM bins)"""
POINTS = """points AS (SELECT o_orderkey AS core_id, o_orderstatus AS cruise, CAST(o_orderdate AS DATE) AS time, CAST(o_custkey % 90 - 90 AS DOUBLE) AS lat,
  CAST((o_custkey * 7) % 360 - 180 AS DOUBLE) AS lon, o_totalprice / 50000 AS hi, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / 500000 END AS hs,
  o_orderpriority AS i_type FROM orders)"""
HOURLY = """hourly AS (SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, user_id % 10 AS cell, avg(value) / 1e5 AS u, (max(value) - 60) / 1e5 AS v
  FROM events GROUP BY 1, 2, 3)"""
