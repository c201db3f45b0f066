"""Operator 3: removing long passages that occur more than once, with a logarithmic family of suffix indexes.

A passage is a string of `length` bytes (a window). Of the suffixes of a text
only anchored ones are indexed: the anchor of a window is its least hashed run
of `gram` bytes (leftmost of equal ones), so equal windows have their anchor at
the same place, and about two in `length - gram` suffixes are anchors. The
windows of one anchor are consecutive; together they are the anchor's run.

Documents come in batches, about one for every doubling of the corpus. A batch
gets its sparse suffix array: its anchored suffixes in the order of their first
16 bytes and then of the hash of their first `gram` bytes, equal ones collapsed
to one entry. Levels of the family hold 2^i batches or nothing. The array of a
new batch is merge-scanned against every level: both are in order, so a scan
puts neighbours side by side and finds those that match in `gram` bytes. In the
same pass levels of equal size merge geometrically, each suffix a logarithmic
number of times. An entry that was in a match keeps that mark, so the live
levels hold all matches in the end. Arrays are cut into parts by the hash of
the first `gram` bytes, which no match crosses; a part is one task's unit and
bounded by the number of parts, which grows with the data.

A match is a seed. Suffixes with a match are extended to `length` bytes in
three steps, each exact and each on what the one before left open:

1. runs that are equal as a whole occur twice, with all their windows;
2. blocks of 16 windows: if even the bytes that all 16 share are alone, none of
   them occurs twice; if the bytes that they span together occur twice, all do;
3. single windows of blocks that are neither.

Strings are compared by two 64-bit hashes, of their first `gram` bytes from the
anchor and of the whole. From step to step only one member of each class of
equal strings goes on, so large groups of copies shrink to one row in the
map-side aggregation and no group meets in one task.

Null or empty text: no bytes, nothing removed. Texts shorter than `length` keep
everything; longer ones are read whole, in overlapping cuts, however long. Of
equal windows every one goes, the first too, so there are no ties to break.
Repeated rows are documents of their own, so their long texts go, also where
they share an id. Null ids stay null. An empty table gives an empty one. Only
the named columns are read, so others may clash with the output's names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nilas.llm.common import dealt_anew, discard, row_key, written

BASE = 0x5851F42D4C957F2D
POSITION = np.uint64(20)
#: Bytes hashed at once; positions in them fit in POSITION bits.
PIECE = 1 << 18
BLOCK = 16


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, of its inverse, and a random number for each byte."""
    n = 1 << 20
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down, letter = powers()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(letter[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def anchors(hashed: Hashed, windows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """windows: sorted starts of whole windows. Returns anchor, first and last window and beginning's hash of each run."""
    grams = hashed.grams(gram)
    key = (grams >> POSITION << POSITION) | np.arange(len(grams), dtype=np.uint64)
    span = length - gram + 1
    rows = -(-len(key) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(rows, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[windows], left[windows + span - 1]) & np.uint64((1 << int(POSITION)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
    last = np.r_[new[1:] - 1, len(windows) - 1]
    return at[new], windows[new], windows[last], grams[at[new]]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts gathered to pieces of about PIECE bytes: bytes, starts of windows, and per text its number and its place in the piece.

    A longer text is yielded alone, however long; the caller cuts it.
    """
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if group and size + len(t) > PIECE:
            yield gathered(texts, group, length)
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield gathered(texts, group, length)


def gathered(texts: list[bytes], group: list[int], length: int):
    sizes = np.array([len(texts[i]) for i in group])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    windows = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin, sizes, strict=True)])
    return np.frombuffer(b"".join([texts[i] for i in group]), dtype=np.uint8), windows, np.array(group), begin


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts as they do."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i]
    return out


def suffixes(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, anchor, first and last window, beginning's hash, run's hash and first 16 bytes of all anchored suffixes."""
    for data, windows, group, begin in pieces(texts, length):
        at = 0
        while at < len(windows):
            # A long text is cut where a run ends: the last run of a cut is left to the next one.
            base = int(windows[at])
            part = windows[at : at + PIECE] if len(data) > 2 * PIECE else windows[at:]
            here = data[base : int(part[-1]) + length]
            hashed = Hashed(here)
            p, lo, hi, head = anchors(hashed, part - base, length, gram)
            if at + len(part) < len(windows):
                p, lo, hi, head = p[:-1], lo[:-1], hi[:-1], head[:-1]
                at = int(np.searchsorted(windows, base + hi[-1] + 1))
            else:
                at = len(windows)
            run = hashed.of(lo, hi + length)
            owner = np.searchsorted(begin, lo + base, side="right") - 1
            shift = base - begin[owner]
            yield group[owner], p + shift, lo + shift, hi + shift, head, run, leading(here, p), leading(here, p + 8)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def index_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: k1, k2, data. A row per anchored suffix."""
    names = ["k1", "k2", "p", "lo", "hi", "head", "run", "a", "b"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for cut in range(0, whole.num_rows, 512):
                b = whole.slice(cut, 512)
                for owner, p, lo, hi, *hashes in suffixes(b.column(2).to_pylist(), length, gram):
                    i = pa.array(owner)
                    places = [pa.array(x.astype(np.int32)) for x in (p, lo, hi)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), *places, *map(signed, hashes)], names=names)

    return docs.mapInArrow(run, "k1 long, k2 long, p int, lo int, hi int, head long, run long, a long, b long")


#: How often a beginning stands in an array: once, or more often with equal runs, or with different ones.
ONCE, EQUAL_RUNS, DIFFERENT_RUNS = 0, 1, 2
ENTRY = "a long, b long, head long, run long, times byte"
NAMES = ["a", "b", "head", "run", "times"]


def scanned(entries: list[np.ndarray], stays: np.ndarray) -> list[np.ndarray]:
    """Merge scan of arrays (a, b, head, run, times; each in order). Returns the array that the entries marked in `stays` make.

    Neighbours of equal beginnings are a match, which the merged entry's `times` tells from then on.
    """
    a, b, head, run, times = entries
    if not len(a):
        return entries
    order = np.lexsort((head, b, a))
    a, b, head, run, times, stays = (x[order] for x in (a, b, head, run, times, stays))
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (head[1:] == head[:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    n = np.diff(np.r_[starts, len(a)])
    first, last = np.minimum.reduceat(run, starts), np.maximum.reduceat(run, starts)
    most = np.maximum.reduceat(times, starts)
    state = np.where((first != last) | (most == DIFFERENT_RUNS), DIFFERENT_RUNS, np.where(n > 1, EQUAL_RUNS, most)).astype(np.int8)
    keep = np.logical_or.reduceat(stays, starts)
    return [x[keep] for x in (a[starts], b[starts], head[starts], first, state)]


def entries_of(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    kinds = (np.uint64, np.uint64, np.uint64, np.int64, np.int8)
    return [table.column(n).to_numpy().view(k) for n, k in zip(NAMES, kinds, strict=True)]


def as_arrow(entries: list[np.ndarray]) -> list[pa.Array]:
    a, b, head, run, times = entries
    return [signed(a), signed(b), signed(head), pa.array(run), pa.array(times)]


class IndexFamily:
    """Levels of sparse suffix arrays: level i holds 2^i batches or nothing.

    A level is a table in the shared folder, a file per part in suffix order.
    Adding a batch is one job: each task sorts the batch's suffixes of a part,
    merge-scans them against that part of every level and writes them merged
    with the levels that are due.
    """

    def __init__(self, parts: int) -> None:
        self.parts, self.levels = parts, []

    def add(self, rows: DataFrame) -> None:
        def collapse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What a task reads, equal beginnings once: a hot one isn't shuffled row by row."""
            for x in found:
                yield pa.RecordBatch.from_arrays(as_arrow(scanned(entries_of(x), np.ones(x.num_rows, dtype=bool))), names=NAMES)

        def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = [(entries_of(x), x.column("stays").to_numpy(zero_copy_only=False)) for x in found]
            if met:
                entries = [np.concatenate(c) for c in zip(*[e for e, _ in met], strict=True)]
                done = pa.RecordBatch.from_arrays(as_arrow(scanned(entries, np.concatenate([s for _, s in met]))), names=NAMES)
                yield from (done.slice(at, 50_000) for at in range(0, done.num_rows, 50_000))

        due = next((i for i, level in enumerate(self.levels) if level is None), len(self.levels))
        met = rows.select("a", "b", "head", "run", F.lit(ONCE).cast("byte").alias("times")).mapInArrow(collapse, ENTRY).withColumn("stays", F.lit(True))
        for i, level in enumerate(self.levels):
            if level is not None:
                met = met.unionByName(level.withColumn("stays", F.lit(i < due)))
        made = written(met.repartition(self.parts, "head").mapInArrow(merge, ENTRY), "level")
        discard(*self.levels[:due])
        self.levels = [*[None] * due, made, *self.levels[due + 1 :]]

    def matches(self) -> DataFrame:
        """head and differ (whether their runs do) of the beginnings that stand twice."""
        live = [x for x in self.levels if x is not None]
        whole = live[0]
        for x in live[1:]:
            whole = whole.unionByName(x)
        return whole.where(F.col("times") > ONCE).groupBy("head").agg((F.max("times") == DIFFERENT_RUNS).alias("differ"))

    def close(self) -> None:
        discard(*[x for x in self.levels if x is not None])


def contexts(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """The bytes around the anchors of open runs, enough for all blocks that a run meets; `off` is where they start in the text."""
    asked = open_runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "lo", "hi", "head")).alias("asked"))
    met = docs.join(asked.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "data", "asked")
    names = ["k1", "k2", "p", "lo", "hi", "head", "off", "size", "bytes"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for cut in range(0, whole.num_rows, 64):
                b = whole.slice(cut, 64)
                rows = []
                for k1, k2, data, asked in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    for x in asked:
                        p, lo, hi = x["p"], x["lo"], x["hi"]
                        start = max(0, p - (p - lo) // BLOCK * BLOCK - BLOCK + 1)
                        stop = min(len(data), p - (p - hi) // BLOCK * BLOCK + length)
                        rows.append((k1, k2, p, lo, hi, x["head"], start, len(data), data[start:stop]))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return met.mapInArrow(run, "k1 long, k2 long, p int, lo int, hi int, head long, off int, size int, bytes binary")


def around(b: pa.RecordBatch) -> tuple[Hashed, dict[str, np.ndarray]]:
    """The hashed bytes of a batch of contexts, and their columns; `shift` turns a place in a text to one in the bytes."""
    data = b.column("bytes").to_pylist()
    c = {n: b.column(n).to_numpy().astype(np.int64) for n in ("k1", "p", "lo", "hi", "head", "off", "size")}
    c["shift"] = np.r_[0, np.cumsum([len(x) for x in data])[:-1]].astype(np.int64) - c["off"]
    return Hashed(np.frombuffer(b"".join(data), dtype=np.uint8)), c


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of inclusive ranges: the row and the value of each element."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def block_rows(ctx: DataFrame, length: int) -> DataFrame:
    """A row per block of windows of each open run, with the hash of what its windows share and of what they span."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in found:
            for cut in range(0, all_rows.num_rows, 512):
                b = all_rows.slice(cut, 512)
                hashed, c = around(b)
                row, t = spread((c["p"] - c["hi"]) // BLOCK, (c["p"] - c["lo"]) // BLOCK)
                at, shift = c["p"][row] - BLOCK * t, c["shift"][row]
                core = hashed.of(at + shift, at - BLOCK + 1 + length + shift)
                fits = (at - BLOCK + 1 >= 0) & (at + length <= c["size"][row])
                start, stop = np.where(fits, at - BLOCK + 1, at) + shift, np.where(fits, at + length, at) + shift
                i = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k1").take(i), b.column("k2").take(i), b.column("p").take(i), b.column("head").take(i), pa.array(t.astype(np.int32)),
                     signed(core), pa.array(hashed.of(start, stop).view(np.int64), mask=~fits)],
                    names=["k1", "k2", "p", "head", "t", "core", "span"],
                )

    return ctx.mapInArrow(run, "k1 long, k2 long, p int, head long, t int, core long, span long")


def window_rows(ctx: DataFrame, length: int) -> DataFrame:
    """A row per window of the blocks in `ts` (within the run) of each context."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in found:
            for cut in range(0, all_rows.num_rows, 512):
                b = all_rows.slice(cut, 512)
                hashed, c = around(b)
                ts = b.column("ts").to_pylist()
                n = np.array(list(map(len, ts)))
                row = np.repeat(np.arange(len(n)), n)
                t = np.concatenate([np.array(x, dtype=np.int64) for x in ts])
                first = np.maximum(c["lo"][row], c["p"][row] - BLOCK * t - BLOCK + 1)
                last = np.minimum(c["hi"][row], c["p"][row] - BLOCK * t)
                k, s = spread(first, last)
                row = row[k]
                d = c["p"][row] - s
                head = mixed(c["head"][row].view(np.uint64) + d.astype(np.uint64) * np.uint64(BASE))
                i = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k1").take(i), b.column("k2").take(i), pa.array(s.astype(np.int32)), signed(head), signed(hashed.of(s + c["shift"][row], s + length + c["shift"][row]))],
                    names=["k1", "k2", "s", "head", "text"],
                )

    return ctx.mapInArrow(run, "k1 long, k2 long, s int, head long, text long")


def indexed(rows: DataFrame, part_rows: int = 500_000, least_batch: int = 1 << 20) -> IndexFamily:
    """The family of all anchored suffixes, added batch by batch."""
    n = rows.count()
    batches = 1 + int(np.ceil(np.log2(1 + n / least_batch)))
    family = IndexFamily(max(1, -(-n // part_rows)))
    batch = F.pmod(F.xxhash64(F.lit(5), "k1", "k2"), F.lit(batches))
    for i in range(batches):
        family.add(rows.where(batch == i))
    return family


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: k1, k2, data. k1, k2 and the packed starts and stops of spans whose windows all occur twice; they overlap and touch."""
    rows = written(index_rows(docs, length, gram), "suffixes")
    family = indexed(rows)
    matched = written(rows.drop("a", "b").join(dealt_anew(family.matches()), "head"), "matched")
    family.close()
    discard(rows)

    # Step 1: whole runs.
    place = ["k1", "k2", "p", "lo", "hi"]
    runs = matched.groupBy("head", "run").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("one"), F.first("differ").alias("differ"))
    runs = written(runs, "runs")
    twice = runs.where(F.col("n") > 1).select("head", "run")
    spans = matched.join(twice, ["head", "run"]).select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))

    # Step 2: blocks of windows of one run of each class, where a beginning has several.
    ctx = written(contexts(docs, runs.where("differ").select("one.*", "head"), length), "contexts")
    blocks = written(block_rows(ctx, length), "blocks")
    one = F.struct("k1", "k2", "p")
    alone = F.when(F.col("span").isNull(), one)  # a block that leaves its text can only be resolved by windows
    classes = blocks.withColumn("alone", alone).groupBy("head", "t", "core", "span", "alone").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    shared = classes.groupBy("head", "t", "core").agg(F.count("*").alias("classes"), F.sum("n").alias("rows"))
    double = classes.where((F.col("n") > 1) & F.col("span").isNotNull()).select("head", "t", "core", "span")
    at = F.col("p") - BLOCK * F.col("t")
    spans = spans.union(blocks.join(double, ["head", "t", "core", "span"]).select("k1", "k2", (at - BLOCK + 1).alias("start"), (at + length).alias("stop")))

    # Step 3: windows of blocks that share their core with a block of another class.
    unclear = classes.join(shared.where("classes > 1"), ["head", "t", "core"]).select("one.*", "t")
    asked = unclear.groupBy("k1", "k2", "p").agg(F.collect_list("t").alias("ts"))
    windows = written(window_rows(ctx.join(asked, ["k1", "k2", "p"]), length), "windows")
    both = windows.groupBy("head", "text").agg(F.count("*").alias("n")).where("n > 1")
    both = dealt_anew(both).select("head", "text")
    spans = spans.union(windows.join(both, ["head", "text"]).select("k1", "k2", F.col("s").alias("start"), (F.col("s") + length).alias("stop")))
    packed: Column = F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")
    per_doc = written(spans.groupBy("k1", "k2").agg(F.collect_set(packed).alias("spans")), "spans")
    discard(matched, runs, ctx, blocks, windows)
    return per_doc


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64
) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and spans (starts and stops of the removed runs)."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit(1013), F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"),
    )
    per_doc = repeated_spans(slim.select("k1", "k2", "data"), length, gram)
    rows = slim.join(per_doc.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "data", "spans")
    kind = dict(rows.dtypes)["doc_id"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for cut in range(0, whole.num_rows, 256):
                b = whole.slice(cut, 256)
                kept, sizes, removed, out = [], [], [], []
                for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    starts, stops = union_of(np.array(spans or [], dtype=np.int64))
                    edges = [0, *np.column_stack([starts, stops]).ravel().tolist(), len(data)]
                    kept.append(b"".join([data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]))
                    sizes.append(len(data))
                    removed.append(len(data) - len(kept[-1]))
                    out.append([{"start": a, "stop": z} for a, z in zip(starts.tolist(), stops.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>")


def union_of(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans from packed ones; spans that touch become one."""
    packed = np.sort(packed)
    start, stop = packed >> 32, packed & 0xFFFFFFFF
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[new], reach[np.r_[new[1:] - 1, len(start) - 1]]
