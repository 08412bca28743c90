"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and
a step from two hashes of its name). The shards take turns; at its turn a shard claims the
first slot of its order that is free, until no slot is left. So shards hold equal numbers
of slots, within one, and a change of the shard list moves few slots. The table's size is
a parameter and does not follow the data: it is broadcast, and a key's place is one hash
and one look-up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the production table: a prime, about a hundred times its shards.
SLOTS = 6553
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard. A control structure of `slots` entries, filled once."""
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("needs a prime number of slots, and distinct shards, no more than slots")
    orders = []
    for name in shards:
        h = hashlib.md5(name.encode()).hexdigest()
        orders.append((int(h[:8], 16) % slots, int(h[8:16], 16) % (slots - 1) + 1))
    owner, turn_at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, step) in enumerate(orders):
            slot = (offset + turn_at[i] * step) % slots
            while owner[slot] >= 0:
                turn_at[i] += 1
                slot = (offset + turn_at[i] * step) % slots
            owner[slot] = i
            turn_at[i] += 1
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the slots; a null key hashes as an empty one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot int, shard string: one row a slot, out of one literal."""
    owner = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in (n.replace("\\", "\\\\").replace("'", "\\'") for n in shards))
    return spark.sql(f"SELECT pos AS slot, element_at(array({names}), CAST(col AS INT) + 1) AS shard FROM (SELECT posexplode(split('{owner}', ',')))")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with two more columns, slot and shard (replacing columns of those names).

    Equal keys share a place, null ones too; repeated rows stay. The table has `slots`
    rows whatever the data, so broadcasting it is safe and nothing is shuffled.
    """
    spark = rows.sparkSession
    rows = rows.drop("slot", "shard").withColumn("slot", slot_of(rows[key], slots))
    return rows.join(F.broadcast(table_frame(spark, shards, slots)), "slot")


def oracle(table: str, key: str, shards: list[str], slots: int) -> str:
    """DuckDB SQL for doc_id, slot, shard: the table is filled by recursion, one claim a step."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
WITH RECURSIVE names(i, name) AS (VALUES {names}),
orders AS (SELECT i, name, ('0x' || substring(md5(name), 1, 8))::BIGINT % {slots} AS o, ('0x' || substring(md5(name), 9, 8))::BIGINT % {slots - 1} + 1 AS step FROM names),
prefs AS (SELECT list(o ORDER BY i) AS os, list(step ORDER BY i) AS steps FROM orders),
fill(turn, slot, owner) AS (
  SELECT 0, -1::BIGINT, list_transform(range({slots}), lambda x: -1::BIGINT) FROM prefs
  UNION ALL
  SELECT turn + 1, s, list_transform(range({slots}), lambda x: CASE WHEN x = s THEN (turn % {len(shards)})::BIGINT ELSE owner[x + 1] END)
  FROM (SELECT turn, owner, list_filter(list_transform(range({slots}), lambda k: (os[turn % {len(shards)} + 1] + k * steps[turn % {len(shards)} + 1]) % {slots}), lambda x: owner[x + 1] < 0)[1] AS s
    FROM fill, prefs WHERE turn < {slots})
),
placed AS (SELECT slot, (turn - 1) % {len(shards)} AS i FROM fill WHERE turn > 0)
SELECT doc_id, d.slot::INTEGER AS slot, name AS shard
FROM (SELECT doc_id, (('0x' || substring(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots})::BIGINT AS slot FROM {table}) d
JOIN placed USING (slot) JOIN names USING (i)
"""
