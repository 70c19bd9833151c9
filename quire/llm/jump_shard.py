"""Sharding by jump consistent hashing: law `key`.

A row's shard follows from its id and the number of shards alone, without a ring table; with one
shard more, a row either stays or moves to the new one, which takes 1/(n+1) of them.

Slots number the rows of a shard without gaps. No shard is ever one task's work: rows are dealt
into BLOCKS blocks of each shard by id and CRC, the blocks' counts (a table of fixed size) become offsets,
and rows are numbered within their block.

Defined results: a null id hashes as 0; ids that aren't whole numbers are hashed to 64 bits first; a null text has no bytes (size 1, CRC 0); ties in a block are
ordered by id, size and CRC, rows equal in all of these being interchangeable; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BLOCKS = 4096
#: Rows of the table of offsets that are broadcast at most.
BROADCAST_ROWS = 1_000_000

# Fixed values of the published algorithm: the generator's multiplier and the range of a draw.
MULTIPLIER = 2862933555777941757
DRAW = 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. Buckets only ever go up, so `shards` rounds are enough."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    for _ in range(shards + 1):
        live = ahead < shards
        if not live.any():
            break
        at = np.where(live, ahead, at)
        stepped = key * np.uint64(MULTIPLIER) + np.uint64(1)
        key = np.where(live, stepped, key)
        draw = (key >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = np.where(live, ((at + 1) * (DRAW / draw)).astype(np.int64), ahead)
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long column."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard for every row; texts don't leave their partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    key = F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(0).cast("long"))
    sized = docs.select(F.col(id_col).alias("id"), key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sized.select("*", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"))
    placed = placed.withColumn("block", F.pmod(F.pmod(F.col("key"), F.lit(BLOCKS)) + F.col("text_crc32"), F.lit(BLOCKS)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards * BLOCKS rows at most
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if shards * BLOCKS <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "block").orderBy(F.col("id").asc_nulls_first(), "size", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "block"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
