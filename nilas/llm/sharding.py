"""Operator 4: placing rows on shards through a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table;
shards take turns and claim their best free slot until the table is full. Each
shard so holds an almost equal number of slots, and adding or removing a shard
moves few of them. A row's key is hashed to a slot and looks up its shard in
the broadcast table, whose size is its number of slots, never the data's.

A null key is placed like an empty string. Repeated rows go to the same shard.
Only the key is read, so text of any length, or none, makes no difference.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest table that is broadcast.
MOST_SLOTS = 1_000_003


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The shard number of each slot."""
    if not shards or not len(shards) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, no fewer than shards")
    seeds = [int.from_bytes(hashlib.md5(s.encode()).digest(), "big") for s in shards]
    order = [(x % slots, (x >> 64) % (slots - 1) + 1 if slots > 2 else 1) for x in seeds]
    table, turn, left = [-1] * slots, [0] * len(shards), slots
    for claim in count():
        i = claim % len(shards)
        start, step = order[i]
        while table[at := (start + turn[i] * step) % slots] >= 0:
            turn[i] += 1
        table[at] = i
        left -= 1
        if not left:
            return table


def slot_of(key: Column, slots: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % slots


def place(docs: DataFrame, *, key_col: str = "doc_id", shards: int = 64, slots: int = 65_537) -> DataFrame:
    """key_col, slot and shard of every row."""
    table = fill_table([f"shard-{i}" for i in range(shards)], slots)
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    lookup = docs.sparkSession.range(1).select(F.posexplode(listed).alias("_slot", "_shard"))
    lookup = lookup.select(F.col("_slot").cast("long").alias("slot"), F.col("_shard").cast("int").alias("shard"))
    rows = docs.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select(key_col, "slot", "shard")
