"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts at one hash of its name and steps
by another, which visits all slots because the size is prime. Shards take turns, each claiming the first slot of its
order that is free, until none is left. A key's slot is a hash of the key; the table says whose it is. Shares differ by
at most one slot, and adding or removing a shard moves few keys besides its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters of the query and of the pipeline's last stage.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
TABLE_SIZE = 65_537
#: The table is broadcast, so its size has a fixed bound.
MAX_TABLE_SIZE = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The slots' owners, as positions in ``shards``. The order of ``shards`` has no influence on a name's slots but for turns."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names, and at least one")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, free = [-1] * size, size
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step[shard]) % size
            owner[slot] = shard
            at[shard] = (slot + step[shard]) % size
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The key's slot: 48 bits of its MD5 modulo the size. A null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(size)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with ``slot`` (int), ``shard`` (int, position in ``shards``) and ``shard_name``.

    One broadcast join with the table, whose size is the fixed parameter ``size``; df isn't shuffled. Rows with equal
    keys, repeated rows among them, share a shard; null keys share the shard of the empty text. Columns of df that have
    one of the three names are replaced. An empty df stays empty.
    """
    owners = " ".join(map(str, lookup_table(shards, size)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    filled = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), " ")).alias("slot", "shard"))
    filled = filled.select("slot", F.col("shard").cast("int").alias("shard")).withColumn("shard_name", names[F.col("shard")])
    rest = df.drop("slot", "shard", "shard_name")
    out = rest.withColumn("slot", slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(filled), "slot")
    return out.select(*[out[f"`{c}`"] for c in rest.columns], "slot", "shard", "shard_name")


def oracle_sql(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> str:
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
    with d as (select doc_id, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) % {size} as integer) as slot from documents),
    t as (select unnest(range({size})) as slot, unnest([{owners}]) as shard)
    select d.doc_id, d.slot, cast(t.shard as integer) as shard, ([{names}])[t.shard + 1] as shard_name from d join t on d.slot = t.slot
    """
