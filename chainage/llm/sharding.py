"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and
a step from hashes of its name). Shards take turns; at its turn a shard claims the next
slot of its permutation that is still free. The table is small whatever the data (its
size is a parameter with a ceiling), so it is broadcast, and a row's place is one hash
and one lookup: no shuffle. When a shard leaves, few other keys move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most slots of a table; at 16 bytes a slot the broadcast stays under 64 MB.
MOST_SLOTS = 4_000_000


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 65537, weights: list[int] | None = None) -> np.ndarray:
    """The shard number of each slot. A shard of weight w has w turns in each round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(slots) or slots > MOST_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime of at least the number of shards and at most {MOST_SLOTS}")
    weights = weights or [1] * len(shards)
    offset = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    turn = [i for i, w in enumerate(weights) for _ in range(w)]
    if not turn:
        raise ValueError("all weights are zero")
    table, free, at = [-1] * slots, slots, [0] * len(shards)
    while free:
        for i in turn:
            slot = (offset[i] + at[i] * step[i]) % slots
            while table[slot] >= 0:
                at[i] += 1
                slot = (offset[i] + at[i] * step[i]) % slots
            table[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def place(df: DataFrame, key_cols: list[str], shards: list[str], slots: int = 65537, weights: list[int] | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with slot_col (long) and shard_col (string).

    Defined edge cases: null keys are a key like any other (name a second key column to
    spread them, or any key that holds much of the data); repeated rows go to one shard;
    an empty table stays empty; columns of df that bear the new names are replaced, after
    they have served as keys if they are key columns.
    """
    spark = df.sparkSession
    table = lookup_table(shards, slots, weights)
    taken = {c.lower() for c in df.columns}
    number, name = (next(c for i in range(len(taken) + 1) if (c := f"{x}_{i}") not in taken) for x in ("lookup_slot", "lookup_shard"))
    lookup = spark.createDataFrame(pd.DataFrame({number: np.arange(slots), name: np.array(shards, object)[table]}))
    keys = [F.col(f"`{c.replace('`', '``')}`") for c in key_cols]
    placed = df.withColumn(number, F.pmod(F.xxhash64(*keys), F.lit(slots).cast("long"))).drop(slot_col, shard_col)
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in placed.columns if c != number]
    return placed.join(F.broadcast(lookup), number).select(*kept, F.col(number).alias(slot_col), F.col(name).alias(shard_col))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000, shard_col: str = "shard") -> None:
    """One folder per shard; AQE splits large shards into several tasks, so none waits for one writer."""
    placed.hint("rebalance", shard_col).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)
