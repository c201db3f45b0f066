"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import dealt_anew, discard, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large star links the larger neighbours of each node to its least neighbour, small star the others."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(dealt_anew(least), "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node and component (the smallest node it reaches) for every node that has an edge.

    Every round writes its edges to the shared folder. In the end each node is
    linked to its component's smallest node only.
    """
    edges = written(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        old, edges = edges, written(star(star(edges, True), False), "edges")
        discard(old)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def labelled(classes: DataFrame, counts: DataFrame, links: DataFrame) -> DataFrame:
    """classes: c1, c2, node, copies, one (a struct). Returns c1, c2, links (copies included) and the least `one` of the component.

    counts: node, links. links: node, root. The class of a hot component is
    found by an aggregation and a join, both of which spread its rows.
    """
    final = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    met = classes.join(counts, "node", "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    met = written(met, "labelled")
    least = dealt_anew(met.where("links IS NOT NULL").groupBy("component").agg(F.min("one").alias("_least")))
    all_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    return met.join(least, "component", "left").select("c1", "c2", all_links, F.coalesce("_least", "one").alias("first"))


def forest(n: int, a: np.ndarray, b: np.ndarray, step: int = 20_000) -> np.ndarray:
    """The least member of the set of each of n items, after joining the pairs (a, b).

    Pairs are joined a slice at a time; those whose ends have met by then are
    dropped together, so a dense group costs little more than its members.
    """
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    while len(a):
        for x, y in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        top = np.array([root(i) for i in range(n)])
        apart = top[a[step:]] != top[b[step:]]
        a, b = a[step:][apart], b[step:][apart]
    return np.array([root(i) for i in range(n)], dtype=np.int64)
