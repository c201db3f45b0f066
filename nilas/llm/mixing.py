"""Operator 8: mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order (null last) weigh `weights` in turn and
share the total of all sizes; a target stops at `repeat` times its source's
size and the excess is shared again by weight (water filling, solved with one
running sum over the sources). Blocks of `block` words are given to sources by
the highest quotients target / (2 s + 1), then each source's blocks to its
shards in the same way by their sizes. A shard holds its documents in seeded
order as one stream of words; its quota is that many whole passes and a run of
blocks from a seeded block on (cyclic), so `taken` of a document is closed
arithmetic on its place in the stream.

Null, empty or blank text has size 0 and is never taken; a text of any length is
one document. A document is placed by a hash of its id and text, so a hot or
null id spreads over shards. Repeated rows are documents of their own, side by
side in one shard's stream; which of them a run ends in is the only tie, and
they are alike. With no words at all every target and every taken is 0; an
empty table gives an empty one. Only the named columns are read, so others may
clash with the output's names. A source is never grouped into one task: its
shards hold about `shard_words` words each. What is sorted in one task is a row
for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], repeat: int) -> DataFrame:
    """sources: source, source_size. Adds source_no (from 1) and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("source_no", F.row_number().over(by_name))
        .withColumn("_w", turn.cast("double"))
        .withColumn("_cap", F.col("source_size").cast("double") * repeat)
    )
    steep = Window.orderBy(F.col("_cap") / F.col("_w"), "source_no")
    before, whole = steep.rowsBetween(Window.unboundedPreceding, -1), steep.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    # In the order of cap / weight, the first source that its own level does not lift above its cap sets the level.
    return (
        ranked.withColumn("_at", F.row_number().over(steep))
        .withColumn("_level", level)
        .withColumn("_first", F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_at", "_level")))
        .withColumn("_level", F.min("_first").over(whole)["_level"])
        .select("source", "source_size", "source_no", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))
    )


def apportion(claims: DataFrame, group: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """Seats of each claim by the highest quotients votes / (2 s + 1) in its group; ties to the smaller name.

    With n claims and N seats, a claim of quota q gets between q (1 - n / 2N) - 1/2
    and q (1 + n / 2N) + 1/2 seats, so only the quotients in that range compete: a
    few for each claim, whatever N is.
    """
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    quota = F.when(F.col("_v") > 0, F.col(votes) * F.col(seats) / F.col("_v")).otherwise(0.0)
    span = F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    base = (
        claims.withColumns({"_v": F.sum(votes).over(of), "_n": F.count("*").over(of)})
        .withColumn("_q", quota)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - span) - 1.5)).cast("long"))
        .withColumn("_high", F.ceil(F.col("_q") * (1 + span) + 1.5).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_low").over(of))
    )
    rivals = base.withColumn("_s", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    best = best.orderBy((F.col(votes) / (2 * F.col("_s") + 1)).desc(), name, "_s")
    won = rivals.withColumn("_won", (F.row_number().over(best) <= F.col("_left")) & (F.col("_v") > 0))
    keep = [c for c in claims.columns if c not in (*group, name)]
    return won.groupBy(*group, name).agg(
        *[F.first(c).alias(c) for c in keep], (F.first("_low") + F.sum(F.col("_won").cast("long"))).alias("quota")
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    repeat: int = 3,
    block: int = 8,
    shard_words: int = 1 << 20,
    seed: int = 11,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target and taken, and the first word of the run taken besides whole passes.

    row_col: a column of unique numbers, which is then returned too, as `row`.
    """
    row = ["row"] * (row_col is not None)
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 16).alias("th"),
            *[F.col(row_col).alias("row") for _ in row],
        ),
        "sizes",
    )
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat)
    blocks = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / F.lit(block)).cast("long")
    sources = apportion(sources.withColumn("blocks", blocks), [], "source_no", "target", "blocks").select(
        F.col("source").alias("_source"), "source_no", "source_size", "target", F.col("quota").alias("blocks")
    )
    sources = sources.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", *row, "th", "size", "source_no", "source_size", "target", "blocks",
        (number(seeded(seed, F.lit("shard"), F.col("doc_id"), F.col("th"))) % F.col("_shards")).alias("shard"),
    )
    shards = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    want = F.least(F.col("quota") * block, F.col("shard_size") * repeat)
    holds = F.greatest(F.col("shard_size"), F.lit(1))
    shards = (
        apportion(shards, ["source_no"], "shard", "shard_size", "blocks")
        .withColumn("passes", F.floor(want / holds).cast("long"))
        .withColumn("run", (want % holds).cast("long"))
        .withColumn("first", number(seeded(seed, F.lit("block"), F.col("source_no"), F.col("shard"))) % F.ceil(holds / block).cast("long") * block)
        .select("source_no", "shard", "shard_size", "passes", "run", "first")
    )
    stream = Window.partitionBy("source_no", "shard").orderBy(seeded(seed, F.col("doc_id"), F.col("th")), "doc_id", "size")
    at = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    zero, end = F.lit(0), F.col("at") + F.col("size")
    stop, wrapped = F.col("first") + F.col("run"), F.col("first") + F.col("run") - F.col("shard_size")
    straight = F.greatest(zero, F.least(end, stop, F.col("shard_size")) - F.greatest(F.col("at"), F.col("first")))
    around = F.greatest(zero, F.least(end, wrapped) - F.col("at"))
    return (
        rows.withColumn("at", at)
        .join(shards, ["source_no", "shard"])
        .withColumns({"_straight": straight, "_around": around})
        .select(
            "doc_id", *row, "size", "source_size", "target",
            (F.col("passes") * F.col("size") + F.col("_straight") + F.col("_around")).cast("long").alias("taken"),
            F.when(F.col("_straight") > 0, F.greatest(F.col("first") - F.col("at"), zero)).otherwise(zero).cast("long").alias("run_first"),
        )
    )
