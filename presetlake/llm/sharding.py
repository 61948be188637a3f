"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, and the shards take turns in claiming the next
free slot of theirs. Placement is one hash and one probe of the broadcast table; a shard that goes gives up little more
than its own slots. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table that queries use, and the most that any table may have: it is broadcast whole.
SLOTS, MOST_SLOTS = 65_537, 1_048_583


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not len(shards) <= slots <= MOST_SLOTS or slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            owner[place[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """``slot, shard`` rows of a filled table."""
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(list(owner))), "array<int>")).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The first 60 bits of the key's MD5, modulo the slots."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, slot, shard`` (the name) of each row.

    Rows are placed by id, so repeated rows go together; a null id is placed by its text, and by the empty string if
    that is null too. Other columns are left out. The broadcast table has ``slots`` rows, at most ``MOST_SLOTS``.
    """
    names = F.array(*map(F.lit, shards))
    table = lookup(docs.sparkSession, fill(shards, slots)).select("slot", F.element_at(names, F.col("shard") + 1).alias("shard"))
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), slot_of(key, slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str], slots: int = SLOTS, rows: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows as Parquet, one folder for each shard, ``shard_name=<name>``; columns must not be called so.

    Rows are placed as by ``place``. A salt deals each shard to as many tasks as keep files at about ``rows`` rows; an
    empty table writes none.
    """
    if "shard_name" in docs.columns:
        raise ValueError("shard_name is the name of the folders and can't be a column")
    files = max(1, -(-docs.count() // (rows * len(shards))))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(files)).alias("salt"))
    table = lookup(docs.sparkSession, fill(shards, slots)).select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("shard") + 1).alias("shard_name"))
    placed = row.withColumn("slot", slot_of(F.coalesce("id", "text", F.lit("")), slots)).join(F.broadcast(table), "slot")
    salted = placed.repartition(len(shards) * files, "shard_name", "salt")
    salted.select("row.*", "shard_name").write.partitionBy("shard_name").parquet(path)
