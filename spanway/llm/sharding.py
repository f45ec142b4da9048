"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size: slot
``(offset + k * skip) mod size`` for k = 0, 1, ...; the shards take turns, each
claiming the first slot of its order that is free, until the table is full.  Shards
so get equal numbers of slots (within one), and when a shard comes or goes few
slots change hands.  A row's slot is a hash of its id modulo the size; the table
(size known beforehand, 2,039 rows as registered) is broadcast, so placing a row
takes one look-up and no shuffle.

A weight of w claims w slots a turn.  Cases: a null id is placed as the empty
string; repeated ids go to the same shard; an empty table gives no rows; columns
named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
SIZE = 2039


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The table: for each slot the number of its shard."""
    if not _is_prime(size):
        raise ValueError(f"the table's size must be a prime, not {size}")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have names of their own")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or not sum(turns):
        raise ValueError("weights must be whole numbers, one for each shard and not all 0")
    at = [_number(f"{s}:offset") % size for s in shards]
    skip = [_number(f"{s}:skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k, turn in enumerate(turns):
            for _ in range(min(turn, left)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                table[at[k]] = k
                left -= 1
    return table


def slot_of(key: Column | str, size: int = SIZE) -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % size).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with its columns and ``slot`` and ``shard``."""
    table = fill(shards, size, weights)
    names = ",".join(str(k) for k in table)
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(names), ",")).alias("slot", "_k"))
    lookup = lookup.select("slot", F.get(F.array(*[F.lit(s) for s in shards]), F.col("_k").cast("int")).alias("shard"))
    kept = df.drop("slot", "shard")
    return kept.withColumn("slot", slot_of(key, size)).join(F.broadcast(lookup), "slot").select(*kept.columns, "slot", "shard")


def place_documents(docs: DataFrame) -> DataFrame:
    """doc_id, slot, shard of every row."""
    return assign(docs.select("doc_id"))


#: The turns are played in SQL too: one row of the recursion is one turn.
OP2_SQL = f"""
WITH RECURSIVE names AS (SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 2, '0') AS shard FROM range(0, {len(SHARDS)}) t(k)),
prefs AS (
  SELECT list(CAST(('0x' || substr(md5(shard || ':offset'), 1, 8)) AS BIGINT) % {SIZE} ORDER BY k) AS off,
         list(CAST(('0x' || substr(md5(shard || ':skip'), 1, 8)) AS BIGINT) % {SIZE - 1} + 1 ORDER BY k) AS skip
  FROM names),
turns(t, taken, k, slot) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT t + 1, list_append(taken, s), t % {len(SHARDS)}, s
  FROM (SELECT t, taken, list_filter(list_transform(range(0, {SIZE}), lambda j: (off[t % {len(SHARDS)} + 1] + j * skip[t % {len(SHARDS)} + 1]) % {SIZE}),
                                     lambda x: NOT list_contains(taken, x))[1] AS s
        FROM turns, prefs WHERE t < {SIZE}))
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SIZE} AS slot FROM documents) d
JOIN turns ON turns.slot = d.slot JOIN names ON names.k = turns.k
"""
