"""Joins that align tables, table differences, upserts and store choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_exact(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that fails if a key is on one side only."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full")
    fine = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("keys differ between the tables")).cast("boolean")).otherwise(True)
    return both.where(fine).drop("_a", "_b")


def stack(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of several tables with the name of their table."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def wide(long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(name, names).agg(F.avg(value))


def difference(sim: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Simulated against observed: left join, difference and percent."""
    out = sim.join(obs.withColumnRenamed("value", "obs"), keys, "left").withColumn("diff", F.col("value") - F.col("obs"))
    return out.withColumn("percent", F.when(F.col("obs") != 0, 100 * F.col("diff") / F.col("obs")))


def delta(long: DataFrame, keys: list[str], run: str, value: str, base: str, other: str) -> DataFrame:
    out = wide(long, keys, run, value, [base, other])
    out = out.withColumn("delta", F.col(other) - F.col(base))
    return out.withColumn("relative_percent", F.when(F.col(base) != 0, 100 * F.col("delta") / F.abs(F.col(base))))


def missing_from(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(there, keys, "left_anti")


def same_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of an index that the other one lacks; none: compatible."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).union(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def drifted(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose static values changed, came or went."""
    both = old.alias("a").join(new.alias("b"), keys, "full")
    changed = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return both.where(changed).select(*keys, *[F.col(f"a.{c}").alias(f"old_{c}") for c in columns], *[F.col(f"b.{c}").alias(f"new_{c}") for c in columns])


def signature(files: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """One digest per group of source files, independent of their order."""
    text = F.concat_ws(":", *parts)
    return files.groupBy(*keys).agg(F.sha1(F.concat_ws("|", F.array_sort(F.collect_list(text)))).alias("signature"))


def stale(now: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that aren't done or whose sources changed since."""
    return now.join(done, [*keys, "signature"], "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def resolve(choices: list[str], order: tuple[str, ...] = ("Tb", "Tc"), wanted: str | None = None) -> str:
    """The one partition to read: the wanted one, or the only one in the search order; several are an error."""
    found = [c for c in order if c in choices] if wanted is None else [c for c in choices if c == wanted]
    if not found:
        raise LookupError(f"none of {wanted or order} is there")
    if len(found) > 1:
        raise LookupError(f"more than one store fits: {found}")
    return found[0]


def decide(df: DataFrame, time: str, metric: str, percent: str, limits: dict[str, float]) -> DataFrame:
    """Whether any metric's change on the last day reaches its limit."""
    last = df.agg(F.max(time).alias("_t"))
    final = df.join(F.broadcast(last), F.col(time) == F.col("_t"))  # one row
    over = reduce(lambda x, y: x | y, [(F.col(metric) == m) & (F.abs(F.col(percent)) >= v) for m, v in limits.items()])
    return final.groupBy(time).agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("different"), F.max(F.abs(F.col(percent))).alias("largest_percent"))


def scatter(grid: DataFrame, values: DataFrame, keys: list[str], value: str, fill: float) -> DataFrame:
    """Values back on the whole grid, the rest filled."""
    return grid.join(values, keys, "left").na.fill(fill, [value])


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables; of rows with equal keys the one of the earliest table stays."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn("_part", F.lit(i)) for i, df in enumerate(parts)])
    rest = F.struct(*[c for c in rows.columns if c not in (*keys, "_part")])
    best = rows.groupBy(*keys).agg(F.min_by(rest, "_part").alias("_best"))
    return best.select(*keys, "_best.*")


def ordered_as(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Adds `place`, the position of each name in a fixed order; unknown names come last."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int")
    return df.withColumn("place", F.when(place > 0, place).otherwise(len(names) + 1))


def by_alias(value: Column, names: dict[str, str]) -> Column:
    """The canonical name of each alias, NULL for unknown ones."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-")))


def file_token(value: Column) -> Column:
    """A name that is safe in paths: letters, digits, dots, dashes and single underscores."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", "_"), "[^A-Za-z0-9_.-]+", "_")
    return F.regexp_replace(F.regexp_replace(safe, "_+", "_"), "^_+|_+$", "")


def natural_key(text: Column) -> Column:
    """Sorts runs of digits as numbers, letters without case: run2 before run10."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
