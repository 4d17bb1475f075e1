"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size: start at its offset, go on by its step.
Shards take turns, each claiming the first free slot of its order, until the table is full, so shares differ by one
slot at most, and a changed shard list moves few slots. The table's size is a parameter; it does not grow with the
rows and is broadcast. Placing a row is one hash and one look-up, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and over 100 times the usual number of shards.
SLOTS = 2053
SHARDS = 16
MAX_SLOTS = 1 << 18


def _number(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not 0 < len(shards) <= slots <= MAX_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at most 2^18 that no number of shards exceeds")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % max(slots - 1, 1) + 1 for s in shards]
    table = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard, shard_name): one row for each slot."""
    rows = [(slot, k, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table's size; null as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot (long) and shard (int), replacing columns of these names.

    Rows with equal keys, repeated rows included, get the same shard; a null key counts as an empty text.
    """
    shards = shards or shard_names(SHARDS)
    table = table_frame(df.sparkSession, shards, slots).select("slot", "shard")
    return df.drop("shard").withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> None:
    """Store df with one folder for each shard. Tasks write to each shard themselves: a hot shard needs no shuffle."""
    place(df, key, shards, slots).write.partitionBy("shard").parquet(path)
