"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which a cluster has to set.

    Only a session whose executors are threads of this process (master local)
    may leave it unset; then a temporary folder is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nilas-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.__dict__["written_to"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash128(cols: Iterable[Column | str]) -> list[Column]:
    """Two independent 64-bit hashes of the same columns (a 128-bit key, so that collisions stay out of reach)."""
    cols = list(cols)
    return [F.xxhash64(F.lit(7), *cols), F.xxhash64(F.lit(1013), *cols)]


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id, or for a null one a negative number made from the text."""
    return F.coalesce(
        doc_id.cast("long"),
        -F.lit(1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1),
    )


def dealt_anew(df: DataFrame) -> DataFrame:
    """One row per key, dealt out by all columns.

    A table just grouped by a join's key would be joined where it is, and a hot
    key's rows would all come to that place. After this the join shuffles both
    sides, and adaptive execution can split the large partitions of the other.
    """
    return df.repartition(*df.columns)
