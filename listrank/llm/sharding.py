"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard index of each slot. Each shard walks its own permutation of the slots, (offset + k * skip) mod slots;
    in turns, each claims the next slot of its walk that is still free. Shares differ by one slot at most."""
    if not _prime(slots):
        raise ValueError("slots must be prime, else a walk does not reach every slot")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, one at least and no more than slots")
    at = [_number(f"{name}|offset") % slots for name in shards]
    skip = [_number(f"{name}|skip") % (slots - 1) + 1 for name in shards]
    filled, left = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while filled[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            filled[at[shard]] = shard
            left -= 1
            if not left:
                return filled


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5 as text, modulo slots. A null key counts as the empty text."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """Adds the slot and the shard of each row; every row stays, in its partition. The table that is broadcast has
    `slots` rows of two integers, whatever the input. Equal keys share a shard; rows with a null key share one too.
    Columns of df by the names slot_column and shard_column are replaced. An empty table gives an empty table."""
    spark = df.sparkSession
    filled = lookup_table(shards, slots)
    lookup = spark.createDataFrame([(i, s) for i, s in enumerate(filled)], f"`{slot_column}` int, `{shard_column}` int")
    rest = df.drop(slot_column, shard_column)
    placed = rest.withColumn(slot_column, slot_of(rest[key], slots))
    return placed.join(F.broadcast(lookup), slot_column).select(*[placed[c] for c in rest.columns], placed[slot_column], lookup[shard_column])
