"""Sharding by jump consistent hashing: the key and the number of shards decide, without a ring table.

A key's jumps are drawn from a generator seeded by the key alone. A larger number of shards only
adds later jumps, so that appending a shard moves just the keys whose next jump lands in it.

Slots are dealt in two levels: each shard's rows are spread over bins by a hash of the whole row, as many as keep a bin at
about `BIN_ROWS` rows; rows are numbered within a bin and the bins' sizes give where each bin begins. No task holds a whole
shard. Rows that are equal in id, size and checksum are counted before they are numbered, and so may be of any number.

Defined results: a null key hashes like the text `null`; a null text has 0 bytes and the crc32 of the
empty text; repeated rows, and different rows of one id, go to one shard and get a slot each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.session import parts

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
BIN_ROWS = 50_000
#: Multiplier of the published generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to shards - 1 (Lamping and Veach, 2014), for all keys at once."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    at, reached = np.zeros(len(state), np.int64), np.full(len(state), -1, np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            reached[live] = at[live]
            state[live] = state[live] * STEP + np.uint64(1)
            draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            at[live] = np.floor((reached[live] + 1) * (2147483648.0 / draw)).astype(np.int64)
            live = live[at[live] < shards]
    return reached


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type; the seed is a 64-bit hash of the key as text."""

    @F.arrow_udf("int")
    def jumped(hashes: pa.Array) -> pa.Array:
        return pa.array(jump(np.asarray(hashes, dtype=np.int64).view(np.uint64), shards), pa.int32())

    return jumped(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard (with one shard more)."""
    text, key = F.col(text_col), F.col(id_col)
    bins = parts(docs.count(), BIN_ROWS * shards)
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    )
    own = ["shard", "bin", "doc_id", "text_crc32", "size", "grown_shard"]
    rows = rows.withColumn("bin", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "size", "text_crc32", F.lit(7)), F.lit(bins)).cast("int"))
    different = rows.groupBy(*own).agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = different.withColumn("number", before(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")))
    sizes = different.groupBy("shard", "bin").agg(F.sum("n").alias("n"))
    starts = sizes.select("shard", "bin", before(Window.partitionBy("shard").orderBy("bin")).alias("start"))
    placed = numbered.join(starts, ["shard", "bin"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("number")).alias("slot"), "grown_shard", each.alias("copy"),
    ).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") + F.col("copy")).alias("slot"), "grown_shard")
