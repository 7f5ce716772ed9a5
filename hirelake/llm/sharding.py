"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. Shards take turns, and at each turn
claim the first slot of their permutation that is still free, until the table is full. A key's hash picks a
slot, so placement is one look-up; the shards' shares differ by one slot at most, and when a shard is added
or removed few slots change hands.

The table's size is its prime, whatever the data's size; it is broadcast. Placement uses DataFrame functions
only: md5 of the key, a remainder, and a broadcast hash join on the slot.

Defined results: the key's columns are joined as text, null as the text \\N; a row with null in all of them is
placed like any other; repeated rows go to one shard; an empty table gives no rows; extra columns are kept
by `place` and must not be named `slot` or `shard`, which raises a ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_PRIME = 65537
SHARDS = 64
HEX_DIGITS = 15


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def lookup_table(shards: list[str], prime: int = TABLE_PRIME) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be different, and one at least")
    if prime <= len(shards) or any(prime % d == 0 for d in range(2, int(prime**0.5) + 1)):
        raise ValueError("the table's size must be a prime above the number of shards")
    start = [_hash(f"start {s}") % prime for s in shards]
    skip = [_hash(f"skip {s}") % (prime - 1) + 1 for s in shards]
    owner, free = [-1] * prime, prime
    while free:
        for k in range(min(len(shards), free)):
            while owner[start[k]] >= 0:
                start[k] = (start[k] + skip[k]) % prime
            owner[start[k]] = k
            free -= 1
    return owner


def slot(keys: list[Column], prime: int = TABLE_PRIME) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long") % prime


def table_frame(spark: SparkSession, shards: list[str], prime: int = TABLE_PRIME) -> DataFrame:
    """(slot, shard): the lookup table."""
    owners = ",".join(map(str, lookup_table(shards, prime)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ","))).select(F.col("pos").cast("long").alias("slot"), F.col("col").cast("int").alias("shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], prime: int = TABLE_PRIME) -> DataFrame:
    """df with columns slot (long) and shard (int, an index into `shards`)."""
    if {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError("columns named slot or shard are taken")
    return df.withColumn("slot", slot([F.col(k) for k in keys], prime)).join(F.broadcast(table_frame(df.sparkSession, shards, prime)), "slot")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, files_per_shard: int = 1, prime: int = TABLE_PRIME) -> None:
    """One folder per shard; rows are spread over `files_per_shard` files each by their slot."""
    placed = place(df, keys, shards, prime)
    placed.repartition(len(shards) * files_per_shard, "shard", F.col("slot") % files_per_shard).write.partitionBy("shard").parquet(path)
