"""Operator 6: near-duplicate embeddings by a subspace pigeonhole join.

Vectors are normalised and rotated by one fixed random rotation, and their
coordinates split into blocks. cosine >= c means a squared distance of at most
2 - 2c, so in at least one of m blocks the squared distance is at most the
m-th part of it. Each block is range-joined on its own, on all of its
coordinates: vectors go to the cell of their nearest pivot, and visit the later
cells whose border is within the block's radius, as only there can a partner
be. Cells are cut into tiles of bounded size, and in a pair of tiles one matrix
product finds the pairs within the block's budget. These candidates are
verified by their cosine in double precision, and a pair is counted in the
first of its blocks only. Equal vectors are joined once, as a class. Only link
counts and spanning links leave a task.

Pivots are the vectors with the smallest hashes, one for each `cell_rows`
vectors and at most `most_pivots`. What they prune depends on the data: vectors
without any clusters visit nearly all cells, and the join is then one of all
tiles with all, which exactness does not spare.

Vectors that are null or empty, all zero or hold null or non-finite components
link with nothing. Vectors meet only those of their own length. A null id is
replaced by a negative number made from the vector. Repeated rows are copies of
one vector and count as links of one another. An id on several vectors names
several nodes: each row gets the links and the component of its own vector. An
empty table gives an empty one. There are no ties: a component's id is the
smallest id of its rows. Only the two named columns are read, so others may
clash with the output's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import discard, hash128, written
from nilas.llm.components import forest, labelled


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: squares can't overflow
    return (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ rotation(x.shape[1])


def bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    edge = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True))


def packed(vec: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array((vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def cells_of(y: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of every stay: first each row's home (in order of rows), then its visits to later cells.

    A partner within the radius whose home is another cell lies beyond the plane
    between the two pivots, so that plane is within the radius too.
    """
    d = (y**2).sum(axis=1)[:, None] - 2 * y @ pivots.T + (pivots**2).sum(axis=1)[None, :]
    home = d.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)))
    near = d - d[np.arange(len(y)), home][:, None] <= 2 * radius * apart[home] + 1e-9
    near &= np.arange(len(pivots))[None, :] > home[:, None]
    row, cell = np.nonzero(near)
    return np.r_[np.arange(len(y)), row], np.r_[home, cell]


def stays(reps: DataFrame, cosine: float, blocks: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """A row per vector, block and cell that it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array(b.column(1).to_pylist(), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                y = rotated(packed(part.column(2), dim))
                cuts = bounds(dim, blocks)
                radius = np.sqrt(2 * (1 - cosine) / len(cuts)) * (1 + 1e-6)
                for i, (lo, hi) in enumerate(cuts):
                    row, cell = cells_of(y[:, lo:hi], pivots.get(dim, y[:1])[:, lo:hi], radius) if dim in pivots else (np.arange(len(y)), np.zeros(len(y)))
                    n, at = len(row), pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array(np.full(n, dim, np.int32)), part.column(2).take(at), part.column(3).take(at),
                         pa.array(np.full(n, i, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.arange(n) >= len(y))],
                        names=["node", "dim", "vec", "copies", "block", "cell", "visits"],
                    )

    kind = dict(reps.dtypes)["vec"]
    return reps.select("node", "dim", "vec", "copies").mapInArrow(run, f"node long, dim int, vec {kind}, copies long, block int, cell int, visits boolean")


def links_of_tiles(a: tuple, b: tuple, same: bool, block: int, blocks: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tiles that are linked and whose first block within the budget is this one."""
    (xa, ya), (xb, yb) = a, b
    cuts = bounds(ya.shape[1], blocks)
    budget = 2 * (1 - cosine) / len(cuts) * (1 + 1e-9)
    lo, hi = cuts[block]
    # One product gives a.b - |a|^2 / 2 - |b|^2 / 2, minus half the squared distance.
    pa_, pb = ya[:, lo:hi].astype(np.float32), yb[:, lo:hi].astype(np.float32)
    left = np.column_stack([pa_, -(pa_**2).sum(axis=1) / 2, np.ones(len(pa_), np.float32)])
    right = np.column_stack([pb, np.ones(len(pb), np.float32), -(pb**2).sum(axis=1) / 2]).T.copy()
    ua, ub = xa / np.linalg.norm(xa, axis=1, keepdims=True), xb / np.linalg.norm(xb, axis=1, keepdims=True)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // max(1, len(pb)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(left[at : at + step] @ right >= np.float32(-budget / 2 - 1e-5))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 50_000):
            p, q = i[k : k + 50_000], j[k : k + 50_000]
            apart = np.add.reduceat((ya[p] - yb[q]) ** 2, [c for c, _ in cuts], axis=1) <= budget
            ok = (apart.argmax(axis=1) == block) & apart[:, block]
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", ua[p], ub[q]) >= cosine
            out.append((p[ok], q[ok]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])


def join_tiles(pairs: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """pairs: grouped by a pair of tiles of a cell. Returns node, links and root of all linked rows."""

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        dim, block, _, visited, i, j = (k.as_py() for k in key)
        x = packed(table.column("vec"), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        order = np.argsort(nodes, kind="stable")
        x, nodes, copies = x[order], nodes[order], copies[order]
        y = rotated(x)
        visits, tile = table.column("visits").to_numpy()[order], table.column("tile").to_numpy()[order]
        left = np.flatnonzero(~visits & (tile == i))
        right = np.flatnonzero((visits == visited) & (tile == j))
        p, q = links_of_tiles((x[left], y[left]), (x[right], y[right]), i == j and not visited, block, blocks, cosine)
        p, q = left[p], right[q]
        count = np.bincount(p, copies[q], len(nodes)) + np.bincount(q, copies[p], len(nodes))
        met = np.flatnonzero(count)
        roots = forest(len(nodes), p, q) if len(met) else met
        return pa.table({"node": nodes[met], "links": count[met].astype(np.int64), "root": nodes[roots[met]] if len(met) else nodes[met]})

    return pairs.groupBy("dim", "block", "cell", "visited", "i", "j").applyInArrow(solve, "node long, links long, root long")


def near(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cosine: float = 0.9,
    blocks: int = 4,
    tile_rows: int = 32_768,
    cell_rows: int = 262_144,
    most_pivots: int = 1_024,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    raw = F.col(vec_col)
    if dict(vectors.dtypes)[vec_col] != "array<float>":
        raw = raw.cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), -F.lit(1) - F.shiftrightunsigned(F.xxhash64(raw.cast("array<double>")), 1)).alias("id"), raw.alias("vec"))
    usable = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(usable & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", usable).withColumns(dict(zip(("c1", "c2"), hash128(["vec"]), strict=True)))
    reps = rows.where("ok").groupBy("c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = written(reps.withColumns({"dim": F.size("vec").cast("int"), "node": F.monotonically_increasing_id()}), "vectors")

    wanted = min(most_pivots, -(-reps.count() // cell_rows))
    pivots: dict[int, np.ndarray] = {}
    if wanted > 1:  # at most most_pivots vectors
        sample = reps.orderBy("c1", "c2").limit(wanted).select("dim", "vec").collect()
        pivots = {d: rotated(np.array([r["vec"] for r in sample if r["dim"] == d], dtype=np.float64)) for d in {r["dim"] for r in sample}}
    placed = written(stays(reps, cosine, blocks, pivots), "cells")
    key = ["dim", "block", "cell"]
    # A row for each length, block and pivot.
    sizes = placed.groupBy(key).agg(F.count_if(~F.col("visits")).alias("_h"), F.count_if("visits").alias("_v"))
    sizes = sizes.select(*key, F.ceil(F.greatest("_h", "_v") / tile_rows).cast("int").alias("tiles"), (F.col("_v") > 0).alias("_visited"))
    tiled = placed.join(F.broadcast(sizes), key).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    t, every = F.col("tile"), F.sequence(F.lit(0), F.col("tiles") - 1)

    def meeting(visited: bool, i, j):
        return F.transform(every, lambda o: F.struct(F.lit(visited).alias("visited"), i(o).cast("int").alias("i"), j(o).cast("int").alias("j")))

    at_home = meeting(False, lambda o: F.least(t, o), lambda o: F.greatest(t, o))
    visited = F.when(F.col("_visited"), F.concat(at_home, meeting(True, lambda o: t, lambda o: o))).otherwise(at_home)
    meets = F.when(F.col("visits"), meeting(True, lambda o: o, lambda o: t)).otherwise(visited)
    pairs = tiled.withColumn("m", F.explode(meets)).select(*key, "m.visited", "m.i", "m.j", "visits", "tile", "node", "copies", "vec")
    links = written(join_tiles(pairs, cosine, blocks), "links")

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = written(labelled(reps.select("c1", "c2", "node", "copies", F.struct("id").alias("one")), counts, links), "components")
    discard(placed, links, reps)
    out = rows.select("id", "ok", "c1", "c2").join(by_class, ["c1", "c2"], "left")
    component = F.when(F.col("ok"), F.col("first.id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.when(F.col("ok"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )
