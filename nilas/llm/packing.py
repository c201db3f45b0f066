"""Operator 2: packing token sequences, by exact-complement hashing and best fit.

Texts become token ids plus an end id; only documents longer than the capacity
are cut. The plan needs no more than how many pieces each length has (at most
`capacity` numbers, whatever the corpus), so it is made on the driver: from the
longest length down, a single, a pair or a triple of lengths that fills the gap
exactly is consumed as often as its counts allow; what has no exact complement
is filled best-fit. The plan is a list of (pattern, times). Pieces then find
their place by their rank among the pieces of equal length, which is counted in
hash buckets, so a length that a third of all pieces share stays spread out.

Null or empty text: an empty document (one piece: the end id). A text of any
length is tokenized whole and cut into pieces of `capacity` ids. Pieces of one
length change places freely, so ties are broken by id, piece and checksum, and
repeated rows are packed as often as they occur. Null ids stay null. Empty
table: no rows. Columns besides the two named ones are not read, so others may
clash with the output's names.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nilas.llm.bpe import Remembered, of_newer_unicode
from nilas.llm.common import partitions, written

PIECES = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts as little-endian bytes, from remembered ids of their words.

    The vocabulary's pre-tokens never cross white space, nor the border of a
    letter run and other characters unless an apostrophe is near. Texts for
    which such cuts could matter (not in normal form C, special strings, a
    dotted capital I, characters newer than Python's Unicode version) go to the
    library whole.
    """

    SPACED = re.compile("[^ \t-\r]+")
    FINER = re.compile(r"[^\W\d_]+|(?:(?![^\W\d_])[^ \t-\r])+")

    #: The same cuts for texts of Latin-1 characters, in half the time.
    LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    LATIN = re.compile(f"[{LETTERS}]+|[^{LETTERS} \t-\r]+")

    def __init__(self, path: str, remember: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        ends = [i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        self.ends[ends] = True
        self.units = Remembered(self.encode, remember)

    def encode(self, units: list[str]) -> list[bytes]:
        """Ids of each unit; letter runs (one pre-token each) go in lines of many, cut at word ends again."""
        words = [u for u in units if u.isalpha() and "\u0130" not in u]
        lines = [words[at : at + 500] for at in range(0, len(words), 500)]
        out: dict[str, bytes] = {}
        for line, e in zip(lines, self.library.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            raw, stop = ids.tobytes(), stop.tolist()
            out.update(zip(line, map(raw.__getitem__, map(slice, [0, *stop[:-1]], stop)), strict=True))
        rest = [u for u in units if u not in out]
        found = self.library.encode_batch_fast(rest, add_special_tokens=False)
        out.update((u, np.array(e.ids, dtype="<u4").tobytes()) for u, e in zip(rest, found, strict=True))
        return list(map(out.__getitem__, units))

    def pattern(self, text: str) -> re.Pattern:
        if "'" in text:
            return self.SPACED
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.FINER
        return self.LATIN

    def ids(self, texts: list[str]) -> list[bytes]:
        safe = [
            t.isascii() and "<|" not in t or not ("<|" in t or "\u0130" in t or of_newer_unicode(t)) and unicodedata.is_normalized("NFC", t) for t in texts
        ]
        rows = [self.pattern(t).findall(t) if ok else [] for t, ok in zip(texts, safe, strict=True)]
        get = self.units.learn(rows)
        out = [b"".join(map(get, r)) for r in rows]
        whole = [i for i, ok in enumerate(safe) if not ok]
        for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """The process's own, so that what one task has learned serves the next ones of the same worker."""
    return WordIds(path)


def tokenized(
    docs: DataFrame, vocabulary: str, *, id_col: str, text_col: str, end_id: int, capacity: int, with_ids: bool, rows: int = 256
) -> DataFrame:
    """A row for each piece of each document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(vocabulary), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part, owner, cols = batch.slice(at, rows), [], [[] for _ in types]
                for i, raw in enumerate(words.ids(part.column(1).to_pylist())):
                    raw += end
                    for n, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[lo : lo + 4 * capacity]
                        owner.append(i)
                        for c, v in zip(cols, (n, lo // 4, len(cut) // 4, zlib.crc32(cut), cut), strict=False):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, cols, types)], names=names
                )

    return slim.mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)


def exact_fill(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths that sum to the gap, as the counts `have` allow; large ones first."""
    if have[gap]:
        return (gap,)
    if (two := pair_fill(have, gap)) is not None:
        return two
    for c in np.flatnonzero(have[: gap - 1])[::-1].tolist():
        if 3 * c < gap:
            break
        have[c] -= 1
        two = pair_fill(have, gap - c, c)
        have[c] += 1
        if two is not None:
            return (c, *two)
    return None


def pair_fill(have: np.ndarray, total: int, most: int | None = None) -> tuple[int, int] | None:
    """Two lengths (the first at most `most`) that sum to the total: a is indexed by its complement total - a."""
    low, high = (total + 1) // 2, min(total - 1, most or total - 1)
    if high < low:
        return None
    a = np.arange(low, high + 1)
    ok = (have[a] > 0) & (have[total - a] > 0)
    if 2 * low == total:
        ok[0] &= have[low] > 1
    return (int(a[ok][-1]), int(total - a[ok][-1])) if ok.any() else None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every piece once."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        have[n] = c
    plan: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            have[longest] -= 1
            gap, parts = capacity - longest, [longest]
            if gap and (fill := exact_fill(have, gap)):
                parts += fill
            else:  # best fit: always the longest piece that still fits, with an exact end as soon as there is one
                rest = have.copy()
                while gap and len(fits := np.flatnonzero(rest[: gap + 1])):
                    fill = exact_fill(rest, gap) if len(parts) > 1 else None
                    for n in fill or (int(fits[-1]),):
                        rest[n] -= 1
                        parts.append(n)
                        gap -= n
            have[longest] += 1
            used = np.bincount(parts, minlength=capacity + 1)
            at = np.flatnonzero(used)
            times = int((have[at] // used[at]).min())
            have[at] -= times * used[at]
            plan.append((tuple(parts), times))
    return plan


def place_table(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted keys (length and first rank of a run of places), with sequence and offset of each run's first place."""
    used, rows, base = [0] * (capacity + 1), [], 0
    for parts, times in plan:
        at = 0
        for n in parts:
            rows.append(((n << 44) + used[n], base, at))
            used[n] += times
            at += n
        base += times
    key, first, offset = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3).T
    return key.copy(), first.copy(), offset.copy()


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset in it; with_ids adds the ids themselves."""
    spark = docs.sparkSession
    pieces = written(
        tokenized(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, with_ids=with_ids), "pieces"
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = place_table(plan_packing(counts, capacity), capacity)

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, partitions(spark)))).cast("int")
    keyed = pieces.withColumn("_bucket", bucket)
    before = (
        keyed.groupBy("_bucket", "length")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_bucket", "length", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    mine = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = (
        keyed.withColumn("_rank", mine - 1)
        .join(before, ["_bucket", "length"])
        .select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    )
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = table
        for batch in batches:
            rank = batch.column(len(names) - 2).to_numpy()
            want = (batch.column(names.index("length")).to_numpy() << 44) + rank
            at = np.searchsorted(key, want, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first[at] + want - key[at]), pa.array(offset[at])], names=names
            )

    kinds = ", ".join(f"`{n}` {k}" for n, k in pieces.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, `offset` long")
