"""Writers: partitioned, restartable, and quiet where nothing changed."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas import config
from nilas.operators import relational as rel


def there(spark: SparkSession, path: str, mark: str = "/_SUCCESS") -> bool:
    """Whether a written table is at a path of any file system. Writers that replace single partitions leave no mark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{mark}")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir); only a local session may leave that unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nilas-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def spread(df: DataFrame, group: str, files: int) -> DataFrame:
    """Rows of a group dealt to a few tasks, so that a large group is not one task's."""
    others = [c for c in df.columns if c != group]
    return df.repartition(F.col(group), F.pmod(F.xxhash64(*others), F.lit(files)))


def ingest(df: DataFrame, root: str, *, frequency: str = "daily", shift_days: int = 1, files: int = 4) -> None:
    """History by month (daily means are stamped at their end, so they move back a day) or by day (instants stay).

    Only the groups at hand are replaced; each is at most `files` files.
    """
    if config.frequency(frequency) == "daily":
        df = df.withColumn("time", F.col("time") - F.make_dt_interval(days=F.lit(shift_days))).withColumn("ym", F.date_format("time", "yyyy-MM"))
    else:
        df = df.withColumn("ym", F.date_format("time", "yyyy_MM_dd"))
    spread(df, "ym", files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(root)


def changed_groups(files: DataFrame, manifest: DataFrame | None, group: str) -> DataFrame:
    """Groups to write again: new ones, and those whose files' names, sizes or times changed."""
    now = rel.signature(files, [group], [F.col("path"), F.col("size").cast("string"), F.col("mtime").cast("string")])
    return now if manifest is None else rel.stale(now, manifest, [group])


def classification(df: DataFrame, root: str, *, overwrite: bool = False, columns: tuple[str, ...] = ("time", "cell", "fi", "pi", "si")) -> bool:
    """Write a classification's own columns unless it is there already. True if it was written."""
    if not overwrite and there(df.sparkSession, root):
        return False
    df.select(*columns).write.mode("overwrite").parquet(root)
    return True


def metrics(df: DataFrame, root: str, *, overwrite: bool = False, files: int = 4) -> None:
    """Add the metrics (partition `metric`) that aren't there, or replace those at hand."""
    spark = df.sparkSession
    if not overwrite and there(spark, root, ""):
        df = rel.missing_from(df, spark.read.parquet(root).select("metric").distinct(), ["metric"])
    spread(df, "metric", files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(root)


def complete(spark: SparkSession, root: str, rows: int | None = None) -> bool:
    """Whether a table was written to its end, and has the rows that it should have."""
    return there(spark, root) and (rows is None or spark.read.parquet(root).count() == rows)


def forcing(df: DataFrame, root: str, *, rows: int | None = None) -> bool:
    """Write a forcing table unless it is complete; a job that was cut off leaves no mark and is done again. True if it was written."""
    if complete(df.sparkSession, root, rows):
        return False
    df.write.mode("overwrite").parquet(root)
    return True


def weights(spark: SparkSession, root: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Regridding weights, built once and read from then on."""
    if not there(spark, root):
        build().write.mode("overwrite").parquet(root)
    return spark.read.parquet(root)


def backup(spark: SparkSession, root: str, suffix: str = "legacy") -> str:
    """Move a store aside; returns where it is now."""
    to = f"{root}.{suffix}_{datetime.now():%Y%m%d_%H%M%S}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(root)):
        raise FileNotFoundError(root)
    files.delete(path(to), True)
    if not files.rename(path(root), path(to)):
        raise RuntimeError(f"{root} couldn't be moved to {to}")
    return to


def factor_problems(df: DataFrame, columns: tuple[str, ...] = ("ffx", "ffy"), shape: tuple[int, int] | None = None) -> list[str]:
    """What speaks against a table of form factors (nj, ni and the columns) as model input; empty if nothing does."""
    if missing := [c for c in columns if c not in df.columns]:
        return [f"{c} is missing" for c in missing]
    value = {c: F.col(c).cast("double") for c in columns}
    odd = [F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"odd_{c}") for c, v in value.items()]
    low = [F.count_if(v < 0).alias(f"low_{c}") for c, v in value.items()]
    r = df.agg(*odd, *low, (F.max("nj") + 1).alias("nj"), (F.max("ni") + 1).alias("ni"), F.count("*").alias("n")).first()
    out = [f"{c} has values that aren't finite" for c in columns if r[f"odd_{c}"]] + [f"{c} is negative somewhere" for c in columns if r[f"low_{c}"]]
    if r["n"] != (r["nj"] or 0) * (r["ni"] or 0):
        out.append("cells are missing or repeated")
    if shape is not None and (r["nj"], r["ni"]) not in (shape, shape[::-1]):
        out.append(f"{r['nj']} x {r['ni']} cells instead of {shape[0]} x {shape[1]}")
    return out


def append(df: DataFrame, root: str) -> None:
    df.write.mode("append").parquet(root)


def by_kind(df: DataFrame, root: str, *kinds: str) -> None:
    """One folder per hemisphere, ice type or the like."""
    df.write.mode("overwrite").partitionBy(*kinds).parquet(root)


def table(df: DataFrame, root: str) -> None:
    """A small result as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(root)
