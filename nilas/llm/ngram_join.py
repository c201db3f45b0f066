"""Operator 10: Jaccard self-join of word shingles with Bayesian candidate pruning.

1. Every text becomes the set of hashes of its runs of five words (white space
   separates words, letters are lower-cased; a text of fewer words is one shingle) and a MinHash signature. Texts of equal sets form a class and go on
   as one representative.
2. Signature bands gather representatives that may be similar; the components
   of these buckets are closed under every link there can be.
3. Members of a component meet in tiles of bounded bytes. In a pair of tiles
   the signatures are compared a slice at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold falls
   below `tolerance`. All others are verified on the shingle sets themselves.
4. Only link counts and spanning links leave a task, never its pairs.

With 32 bands of 4 rows a pair at the threshold of 0.8 shares no bucket with a
probability of 5e-8, and pruning loses it with at most about `tolerance`.

A null, empty or blank text has no shingles and links with nothing. Texts of any
length are read whole. A null id is replaced by a negative number made from the
text. Repeated rows are copies: they share a class and count as links of one
another. An id on several texts names several documents, each with the class of
its own text. A class is named by its smallest id, and of its rows exactly one
is kept: of that id, and of several such rows the one of the least text hash
and row number. An empty table gives an empty one. Only the named columns are
read, so others may clash with the output's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import dealt_anew, discard, row_key, written
from nilas.llm.components import components, forest, labelled

BANDS, ROWS = 32, 4
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes. Words are hashed with XXH3 (the same in every process) and remembered up to a bound."""

    def __init__(self, words: int = 5, remember: int = 300_000) -> None:
        self.n, self.remember, self.seen = words, remember, {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        seen = self.seen
        new = {w for w in words if w not in seen}
        for w in new:
            seen[w] = xxh3_64_intdigest(w.encode())
        out = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(seen) > self.remember:
            for w in new:
                del seen[w]
        return out

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = text.lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = self.word_hashes(words)
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            out = mixed(out * MIX + h[i : len(h) - k + 1 + i])
        return np.unique(out)


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    size = BANDS * ROWS
    return rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set, 32 bits each."""
    a, b = permutations()
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        values = ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * MIX + rows[:, i])
    return out.view(np.int64)


@lru_cache(8)
def least_matches(threshold: float, tolerance: float, slice_size: int, total: int) -> tuple[int, ...]:
    """After each slice: the fewest equal MinHash values with which P(similarity >= threshold | matches) >= tolerance.

    The prior of the similarity is uniform, so the posterior after m of n equal
    values is Beta(m + 1, n - m + 1), integrated here on a grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(slice_size, total + 1, slice_size):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def features(docs: DataFrame, words: int) -> DataFrame:
    """docs: id, th, row, text. Per row: id, th, row, class hashes, number of shingles and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                c1, c2, n, sig = [], [], [], []
                for text in b.column(3).to_pylist():
                    x = shingler.shingles(text)
                    n.append(len(x))
                    c1.append(int(mixed(x).sum(dtype=np.uint64).view(np.int64)))
                    c2.append(int(mixed(x ^ MIX).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(signature(x).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                    names=["id", "th", "row", "c1", "c2", "n", "sig"],
                )

    return docs.mapInArrow(run, "id long, th long, row long, c1 long, c2 long, n long, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            keys = [band_keys(np.frombuffer(x, dtype=np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, BANDS)), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], names=["node", "key"]
            )

    return reps.select("node", "sig").mapInArrow(run, "node long, key long")


def intersections(a: list[np.ndarray], b: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all wanted pairs of two lists of sorted sets."""
    out = np.zeros(want.shape, dtype=np.int64)
    pairs = np.argwhere(want)
    if len(pairs) <= 4 * (len(a) + len(b)):
        for i, j in pairs.tolist():
            out[i, j] = len(np.intersect1d(a[i], b[j], assume_unique=True))
        return out
    # Many pairs: products of 0/1 matrices over slices of the shingles that both sides hold.
    va, vb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(va, vb)
    ra, rb = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        sides = []
        for v, r, n in ((va, ra, len(a)), (vb, rb, len(b))):
            col = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[col] == v
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[r[hit], col[hit]] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def linked(
    sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list, sets_b: list, same: bool, threshold: float, tolerance: float, slice_size: int = 16
) -> np.ndarray:
    """The matrix of pairs whose similarity is at least the threshold."""
    na, nb = np.array(list(map(len, sets_a))), np.array(list(map(len, sets_b)))
    live = np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :])
    if same:
        live &= np.arange(len(na))[:, None] < np.arange(len(nb))[None, :]
    total = sig_a.shape[1]
    matches = np.zeros(live.shape, dtype=np.int16)
    for at, least in zip(range(0, total, slice_size), least_matches(threshold, tolerance, slice_size, total), strict=True):
        if not live.any():
            return live
        if 8 * live.sum() < live.size:  # few pairs are left
            i, j = np.nonzero(live)
            matches[i, j] += (sig_a[i, at : at + slice_size] == sig_b[j, at : at + slice_size]).sum(axis=1, dtype=np.int16)
        else:
            for k in range(at, at + slice_size):
                matches += sig_a[:, k, None] == sig_b[None, :, k]
        live &= matches >= least
    both = intersections(sets_a, sets_b, live)
    # both / union >= threshold, in whole numbers of thousandths
    t = round(threshold * 1000)
    return live & (1000 * both >= t * (na[:, None] + nb[None, :] - both))


def join_tiles(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """rows: key columns (comp, i, j), tile, node, copies, sig, sets; sorted by key in each partition.

    Returns node, links (copies of linked representatives in this pair of tiles) and root (least node reached in it).
    """

    def solve(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        (_, i, j), tiles = group[0][0], {}
        for _, tile, *rest in group:
            tiles.setdefault(tile, []).append(rest)
        left, right = tiles.get(i, []), tiles.get(j, [])
        if not left or not right:
            return
        sides = [
            (np.array([np.frombuffer(x[2], np.uint32) for x in side]), [np.frombuffer(x[3], np.uint64) for x in side]) for side in (left, right)
        ]
        link = linked(sides[0][0], sides[1][0], sides[0][1], sides[1][1], i == j, threshold, tolerance)
        a, b = np.nonzero(link)
        if not len(a):
            return
        nodes = left if i == j else left + right
        b = b if i == j else b + len(left)
        ids, copies = np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        roots = forest(len(nodes), place[a], place[b])
        count = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        for k in np.flatnonzero(count).tolist():
            yield int(ids[k]), int(count[k]), int(ids[order[roots[place[k]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for b in batches:
                c = [x.to_pylist() for x in b.columns]
                for comp, i, j, tile, *rest in zip(*c, strict=True):
                    yield ((comp, i, j), tile, *rest)

        out: list[tuple] = []
        group: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "links", "root"])

        for row in rows_of():
            if group and group[0][0] != row[0]:
                out.extend(solve(group))
                group = []
                if len(out) > 10_000:
                    yield batch()
            if not group or group[-1] != row:  # of repeated rows one is enough
                group.append(row)
        if group:
            out.extend(solve(group))
        yield batch()

    return rows.mapInArrow(run, "node long, links long, root long")


def similar(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    tile_rows: int = 512,
    tile_bytes: int = 4 << 20,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, class_id (least id of the component), n_links (other rows linked directly) and kept (true for one row of a class).

    row_col: a column of unique numbers, which is then returned too, as `row`.
    """
    slim = docs.select(
        row_key(F.col(id_col), F.col(text_col)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("long").alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = written(features(slim, words), "features")
    some = F.col("n") > 0
    one = F.min(F.struct("id", "th", "row")).alias("one")
    reps = found.where(some).groupBy("c1", "c2").agg(one, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = written(bands(reps), "bands")
    least = keyed.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    near = keyed.join(dealt_anew(least).select("key", "v"), "key").select(F.col("node").alias("u"), "v")
    groups = components(near).select("node", F.col("component").alias("comp"))
    discard(keyed)
    members = groups.join(reps.select("node", "one.id", "one.th", "copies", "n", "sig"), "node")
    sizes = groups.join(reps.select("node", "n"), "node").groupBy("comp").agg(F.count("*").alias("_m"), F.sum("n").alias("_s"))
    tiles = F.greatest(F.ceil(F.col("_m") / tile_rows), F.ceil(8 * F.col("_s") / tile_bytes)).cast("int")
    members = members.join(sizes.select("comp", tiles.alias("tiles")), "comp").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    # The sets of the members, from their texts; only one text of each class is read on.
    texts = slim.drop("row").join(members, ["id", "th"]).select("comp", "tiles", "tile", "node", "copies", "sig", "n", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            _, first = np.unique(whole.column(3).to_numpy(), return_index=True)  # of repeated rows one is enough
            whole = whole.take(pa.array(np.sort(first)))
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = [shingler.shingles(t) for t in b.column(7).to_pylist()]
                ok = pa.array([len(s) == n and signature(s).tobytes() == g for s, n, g in zip(x, b.column(6).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.bool_())
                cols = [*b.columns[:6], pa.array([s.tobytes() for s in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["comp", "tiles", "tile", "node", "copies", "sig", "sets"]).filter(ok)

    kinds = "comp long, tiles int, tile int, node long, copies long, sig binary, sets binary"
    full = texts.mapInArrow(sets, kinds)
    other = full.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = other.select("comp", F.least("tile", "_o").alias("i"), F.greatest("tile", "_o").alias("j"), "tile", "node", "copies", "sig", "sets")
    links = written(join_tiles(pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "tile", "node"), threshold, tolerance), "links")

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = written(labelled(reps.select("c1", "c2", "node", "copies", "one"), counts, links), "labels")
    discard(reps, links)
    out = found.select("id", "th", "row", "c1", "c2", "n").join(by_class, ["c1", "c2"], "left")
    return out.select(
        F.col("id").alias("doc_id"),
        *["row"] * (row_col is not None),
        F.when(some, F.col("first.id")).otherwise(F.col("id")).alias("class_id"),
        F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(some, F.struct("id", "th", "row") == F.col("first")).otherwise(F.lit(True)).alias("kept"),
    )
