"""Operator 5: exact top-k search by inner product, with a KD-tree per shard.

Components become whole numbers (floor of `scale` times each), so scores are
exact. Space is cut by median splits of a sample of at most `most_sample` rows;
rows of one cell of space form its shards of about `shard_rows`, as many as it
needs, so a crowded cell is no larger task than others. Each shard's KD-tree
splits at medians and keeps a tight bounding box for every node. A box bounds
the inner product with a query from above, so nodes are visited best first until
no bound reaches the query's kth score. Queries move in blocks of one cell. A
block first searches a shard of its own cell; then only those shards whose root
box reaches the kth score that one of its queries has found there, with these
scores, so that most nodes fail at once. Queries are a stated set of rows
(`query`); no pair of rows is ever a row of a table. Vectors without clusters
leave no shard out, as their boxes all reach far.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows with a null id. Vectors meet only those of their own length.
A repeated row counts once; an id on several vectors is a candidate with each,
and as a query asks with each, and never finds itself. Ties go to the smaller
id. Scores beyond 64 bits are cut to the range, and ranked as cut. An empty
table gives an empty one. Only the two named columns are read, so others may
clash with the output's names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nilas.llm.common import written

LEAF = 128
#: Scores are cut to this range before they are ranked.
LEAST, MOST = -(2**63), 2**63 - 1


def whole(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-numbered vectors of a table of vectors of one length; repeated rows once."""
    ids = table.column("id").to_numpy()
    x = np.array(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
    x = np.floor(scale * x)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)]
    return ids[new], x[new]


class Tree:
    """Nodes in breadth-first order: bounds of rows, children (0: leaf), boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.first, self.last, self.child, low, high, todo = [], [], [], [], [], [(0, len(ids))]
        for a, z in todo:
            part = x[order[a:z]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            low.append(lo)
            high.append(hi)
            self.first.append(a)
            self.last.append(z)
            widest = int((hi - lo).argmax())
            if z - a > LEAF and hi[widest] > lo[widest]:
                middle = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(part[:, widest], middle)]
                self.child.append(len(todo))
                todo += [(a, a + middle), (a + middle, z)]
            else:
                self.child.append(0)
        self.ids, self.x, self.low, self.high = ids[order], x[order], np.array(low), np.array(high)

    def pack(self) -> list[bytes]:
        kinds = (np.int64, np.float64, np.int64, np.int64, np.int64, np.float64, np.float64)
        parts = (self.ids, self.x, self.first, self.last, self.child, self.low, self.high)
        return [np.asarray(p, dtype=k).tobytes() for p, k in zip(parts, kinds, strict=True)]

    @classmethod
    def unpack(cls, parts: list[bytes], dim: int) -> Tree:
        self = cls.__new__(cls)
        self.ids, self.first, self.last, self.child = (np.frombuffer(parts[i], np.int64) for i in (0, 2, 3, 4))
        self.x, self.low, self.high = (np.frombuffer(parts[i], np.float64).reshape(-1, dim) for i in (1, 5, 6))
        return self

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the candidates that can be among its k best: (score, id), best first. kth: scores to reach."""
        size = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * q.shape[1]
        exact = size < 2.0**52
        if exact:
            x, bounds = self.x, np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        else:
            x, q = to_ints(self.x), to_ints(q)
            bounds = np.maximum(q, 0) @ to_ints(self.high).T + np.minimum(q, 0) @ to_ints(self.low).T
        out = []
        for i in range(len(ids)):
            best: list[tuple] = []  # heap: the worst of the k best on top
            heap, bound, need = [(-bounds[i, 0], 0)], bounds[i], kth[i]
            while heap and -heap[0][0] >= need:
                _, n = heapq.heappop(heap)
                if c := int(self.child[n]):
                    for m in (c, c + 1):
                        if bound[m] >= need:
                            heapq.heappush(heap, (-bound[m], m))
                    continue
                a, z = int(self.first[n]), int(self.last[n])
                scores = x[a:z] @ q[i]
                for j in np.flatnonzero(scores >= need).tolist():
                    if self.ids[a + j] != ids[i]:
                        heapq.heappush(best, (min(max(int(scores[j]), LEAST), MOST), -int(self.ids[a + j])))
                        if len(best) > k:
                            heapq.heappop(best)
                if len(best) == k and best[0][0] > LEAST:
                    need = max(need, best[0][0])
            out.append([(s, -j) for s, j in sorted(best, reverse=True)])
        return out


def to_ints(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


class Cells:
    """Cells of space by median splits, in heap order: a row goes right where its component is greater than the split."""

    def __init__(self, x: np.ndarray, depth: int) -> None:
        self.depth, n = depth, (1 << depth) - 1
        self.axis, self.split, groups = np.zeros(n, dtype=np.int64), np.full(n, np.inf), [x]
        for i in range(n):
            part = groups[i]
            left = right = part[:0]
            if len(part) > 1:
                axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
                at = float(np.partition(part[:, axis], (len(part) - 1) // 2)[(len(part) - 1) // 2])
                self.axis[i], self.split[i] = axis, at
                left, right = part[part[:, axis] <= at], part[part[:, axis] > at]
            groups += [left, right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.split[node])
        return node - ((1 << self.depth) - 1)


def in_cells(rows: DataFrame, cells: dict[int, Cells], scale: float) -> DataFrame:
    """Adds the length `dim` and the cell of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(v) for v in b.column(1)], dtype=np.int32)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = np.floor(scale * np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim))
                cell = cells[dim].of(x) if dim in cells else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), dim, np.int32)), pa.array(cell.astype(np.int32))], names=["id", "vec", "_q", "dim", "cell"])

    return rows.mapInArrow(run, "id long, vec array<double>, _q boolean, dim int, cell int")


def tree_rows(rows: DataFrame, scale: float) -> DataFrame:
    """One row per length and shard: its packed tree."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        cols = {"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32())}
        return pa.table(cols | {f"p{i}": pa.array([p], pa.binary()) for i, p in enumerate(Tree(*whole(table, scale)).pack())})

    return rows.select("id", "vec", "dim", "part").groupBy("dim", "part").applyInArrow(make, "dim int, part int, " + ", ".join(f"p{i} binary" for i in range(7)))


def query_blocks(rows: DataFrame, scale: float) -> DataFrame:
    """One row per length and block: its home shard, ids and vectors."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = whole(table, scale)
        numbers = {n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("dim", "block", "home"), key, strict=True)}
        return pa.table(numbers | {"ids": pa.array([ids.tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary())})

    return rows.select("id", "vec", "dim", "block", "home").groupBy("dim", "block", "home").applyInArrow(make, "dim int, block int, home int, ids binary, vecs binary")


def within_reach(blocks: DataFrame, boxes: DataFrame, page_rows: int = 4096) -> DataFrame:
    """blocks: dim, block, home, vecs, kth; boxes: dim, part, low, high of each shard. dim, block and part of the shards whose box reaches a kth score, but for the home."""

    def paged(key: tuple, table: pa.Table) -> pa.Table:
        joined = [b"".join(table.column(c).to_pylist()) for c in ("low", "high")]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "parts": pa.array([table.column("part").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                         "low": pa.array([joined[0]], pa.binary()), "high": pa.array([joined[1]], pa.binary())})

    pages = boxes.withColumn("page", F.floor(F.col("part") / page_rows)).groupBy("dim", "page").applyInArrow(paged, "dim int, parts binary, low binary, high binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                dim, block, home, vecs, kth, parts, low, high = (c[at].as_py() for c in b.columns)
                q = np.frombuffer(vecs, np.float64).reshape(-1, dim)
                part, low, high = np.frombuffer(parts, np.int32), *(np.frombuffer(x, np.float64).reshape(-1, dim) for x in (low, high))
                with np.errstate(all="ignore"):
                    most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                    need = ~(most + slack < np.frombuffer(kth, np.float64)[:, None]).all(axis=0) & (part != home)
                found = part[need]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), dim, np.int32)), pa.array(np.full(len(found), block, np.int32)), pa.array(found)], names=["dim", "block", "part"]
                )

    return blocks.select("dim", "block", "home", "vecs", "kth").join(pages, "dim").mapInArrow(run, "dim int, block int, part int")


def search_cells(cells: DataFrame, k: int) -> DataFrame:
    """cells: dim, block, ids, vecs, kth (null: none yet), p0..p6. One row per cell: dim, block, and packed query, candidate and score lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                dim, block, ids, vecs, kth, *parts = (c[at].as_py() for c in b.columns)
                ids = np.frombuffer(ids, np.int64)
                q = np.frombuffer(vecs, np.float64).reshape(len(ids), dim)
                need = np.full(len(ids), -np.inf) if kth is None else np.frombuffer(kth, np.float64)
                found = Tree.unpack(parts, dim).search(ids, q, k, need)
                rows = [(int(i), j, s) for i, best in zip(ids, found, strict=True) for s, j in best]
                own = np.array([best[-1][0] if len(best) == k and best[-1][0] > LEAST else -np.inf for best in found], dtype=np.float64)
                cols = [np.array(c, dtype=np.int64).tobytes() for c in (zip(*rows, strict=True) if rows else ((), (), ()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([block], pa.int32()), *[pa.array([c], pa.binary()) for c in (*cols, np.nextafter(own, -np.inf).tobytes())]],
                    names=["dim", "block", "q", "v", "s", "kth"],
                )

    return cells.mapInArrow(run, "dim int, block int, q binary, v binary, s binary, kth binary")


def opened(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.concatenate([np.frombuffer(x, np.int64) for x in c.to_pylist()] or [np.empty(0, np.int64)]) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return found.select("q", "v", "s").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    shard_rows: int = 8192,
    block_rows: int = 1024,
    most_sample: int = 65_536,
) -> DataFrame:
    """query_id, rank, vec_id and score; `query` is a condition on the id column that names the queries."""
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1.7e308 / scale))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(query, F.lit(False)).alias("_q"))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(fine).dropDuplicates(["id", "vec"])
    rows = written(rows, "vectors")

    # Cells of space, with 16 sampled rows each at least: the rows with the smallest hashes, by a bound on the hash.
    n = rows.count()
    share = min(1.0, most_sample / max(1, n))
    small = F.shiftrightunsigned(F.xxhash64(F.lit(3), "id", "vec"), 2) <= F.lit(int(share * 2**62))
    depth = int(np.ceil(np.log2(max(1, min(n / shard_rows, share * n / 16)))))
    cells: dict[int, Cells] = {}
    if depth:
        sample: dict[int, list] = {}
        for r in rows.where(small).select("vec").limit(2 * most_sample).collect():
            sample.setdefault(len(r["vec"]), []).append(r["vec"])
        cells = {dim: Cells(np.floor(scale * np.array(v)), depth) for dim, v in sample.items()}
    placed = in_cells(rows, cells, scale)
    # A row per length and cell: how many shards and blocks it needs, and where their numbers begin.
    found = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("_q").alias("asked")).orderBy("dim", "cell").collect()
    plan, shards, blocks = [], 0, 0
    for r in found:
        mine = (-(-r["n"] // shard_rows), -(-r["asked"] // block_rows))
        plan.append((r["dim"], r["cell"], shards, mine[0], blocks, max(1, mine[1])))
        shards, blocks = shards + mine[0], blocks + mine[1]
    plan = spark.createDataFrame(plan, "dim int, cell int, shard0 int, shards int, block0 int, blocks int")
    hashed = F.xxhash64("id", "vec")
    numbered = placed.join(F.broadcast(plan), ["dim", "cell"]).select(
        "id", "vec", "_q", "dim", "shard0", "shards",
        (F.col("shard0") + F.pmod(hashed, F.col("shards"))).cast("int").alias("part"), (F.col("block0") + F.pmod(hashed, F.col("blocks"))).cast("int").alias("block"),
    )
    trees = written(tree_rows(numbered, scale), "trees")
    home = (F.col("shard0") + F.pmod("block", "shards")).cast("int").alias("home")
    queries = written(query_blocks(numbered.where("_q").select("id", "vec", "dim", "block", home), scale), "queries")

    parts = [f"p{i}" for i in range(7)]
    columns = ["dim", "block", "ids", "vecs", "kth", *parts]
    own = queries.withColumnsRenamed({"home": "part"}).withColumn("kth", F.lit(None).cast("binary"))
    first = written(search_cells(own.join(trees, ["dim", "part"]).select(columns), k), "home")
    known = queries.join(first.select("dim", "block", "kth"), ["dim", "block"])
    root = lambda c: F.substring(c, F.lit(1), 8 * F.col("dim"))
    met = within_reach(known, trees.select("dim", "part", root("p5").alias("low"), root("p6").alias("high")))
    away = written(met, "reach").join(known.drop("home"), ["dim", "block"])
    away = away.repartition(max(1, min(shards * blocks, 10_000)), "dim", "block", "part") if shards > 1 else away
    rest = search_cells(away.join(trees, ["dim", "part"]).select(columns), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = opened(first).union(opened(rest)).withColumn("rank", F.row_number().over(best))
    return answers.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
