"""Sharding by a permutation-filled lookup table (consistent hashing), DataFrame only.

Each shard has a preference order over the slots of a prime-sized table (offset and
skip, both from md5 of its name).  Shards take turns claiming their next free slot
until the table is full, so slot counts differ by at most one and adding or removing a
shard moves few keys.  The table's size is a parameter, not a function of the data: it
is broadcast, and placement is one hash and one equi-join without a shuffle.

Defined cases: a null key is placed as the text ``\\N``; an empty table gives no rows;
other columns are kept (working columns carry the prefix ``__sh_``), but for those with the
names of the two results, which may be chosen (``slot_col``, ``shard_col``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE, SHARDS = 10_007, 64
NULL_KEY = "\\N"


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot to shard number."""
    if not shards or not _is_prime(size) or size < len(shards):
        raise ValueError("needs shards and a prime table size of at least their number")
    steps = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        steps.append((int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1))
    table, turn, filled = [-1] * size, [0] * len(shards), 0
    while filled < size:
        for k, (offset, skip) in enumerate(steps):
            while True:
                slot = (offset + turn[k] * skip) % size
                turn[k] += 1
                if table[slot] < 0:
                    break
            table[slot] = k
            filled += 1
            if filled == size:
                break
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """The lookup table as rows, made in the JVM from one string constant."""
    text = ",".join(map(str, table))
    slots = spark.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(text), ",")).alias("__sh_slot", "__sh_shard"))
    return slots.select("__sh_slot", F.col("__sh_shard").cast("int").alias("__sh_shard"))


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with its slot and shard number; rows stay where they are."""
    lookup = F.broadcast(table_frame(df.sparkSession, lookup_table(shards, size)))
    keyed = df.withColumn("__sh_key", slot_of(F.col(f"`{key}`"), size))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    return keyed.join(lookup, F.col("__sh_key") == F.col("__sh_slot")).select(*kept, F.col("__sh_key").alias(slot_col), F.col("__sh_shard").alias(shard_col))


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, salts: int = 8, size: int = TABLE_SIZE) -> None:
    """Parquet with a folder a shard.  A hot key's shard is spread over ``salts`` tasks."""
    placed = place(df, key, shards, size, "__sh_s", "shard")
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    placed.withColumn("__sh_salt", salt).repartition("shard", "__sh_salt").drop("__sh_salt", "__sh_s").write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def _digest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"))


def sql() -> str:
    table = ",".join(map(str, lookup_table(shard_names())))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS l),
k AS (SELECT doc_id, strlen(text)::BIGINT AS n_bytes, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 12))::BIGINT % {TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, l[slot + 1]::INTEGER AS shard, n_bytes FROM k, t
"""
