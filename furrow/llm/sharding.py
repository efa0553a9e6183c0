"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size; the shards take turns, each claiming the
first slot of its order that is still free, until all slots are taken. So shares differ by one slot at most, and adding
or removing a shard moves little more than its share of the rows. A row's key is hashed to a slot; the table is
broadcast, its size fixed by the parameters, so a placement is one lookup. All of it is built-in expressions.

A null key is placed like the empty string. Rows with equal keys share a shard. An empty table gives an empty one; an
empty list of shards, repeated shard names, or fewer slots than shards raise. Columns of the input are carried; `slot`
and `shard` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import unused

#: Slots (prime, over a hundred for each shard) and shards of the registered query.
SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def number(text: str) -> int:
    """First 60 bits of the MD5 of the text."""
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def filled_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """Index of the shard that holds each slot. Bounded by the parameters: about slots * log(slots) steps."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    offset = [number(f"{s}/offset") % slots for s in shards]
    skip = [number(f"{s}/skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    turn, table = [0] * len(shards), [-1] * slots
    for claim in range(slots):
        i = claim % len(shards)
        while table[slot := (offset[i] + turn[i] * skip[i]) % slots] >= 0:
            turn[i] += 1
        table[slot] = i
    return table


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def placed(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`rows` with `slot` (long) and `shard` (its name)."""
    table = filled_table(tuple(shards), slots)
    listed = F.split(F.lit("\n".join(shards[i] for i in table)), "\n")
    rows = rows.drop("shard")
    place = unused(rows, "shard_slot")
    lookup = rows.sparkSession.range(1).select(F.posexplode(listed).alias(place, "shard"))
    rows = rows.withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(lookup), F.col("slot") == F.col(place).cast("long"), "left").drop(place)
