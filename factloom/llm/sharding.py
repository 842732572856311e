"""Sharding by jump consistent hashing (operator 6).

A stable key's hash walks a pseudo-random sequence of jumps; the last one below the
shard count is the shard. There is no ring table: (key, shard count) decide, and
with one more shard only the expected 1/(n+1) of the keys move, all into the new one.

One narrow pass reads the texts (their bytes and checksum are taken in the JVM, so
texts don't reach Python) and numbers the rows of each shard inside each partition;
the partitions' few counts give the offsets that make the slots gapless. Nothing is
shuffled by shard, so a shard's size doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import cut, free_name, read_table

#: Fixed: the multiplier of the jump hash's linear congruential generator.
MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys at once."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64)
    last, nxt = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        last[going] = nxt[going]
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[going] = ((last[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[nxt[going] < shards]
    return last.astype(np.int32)


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    law is ``key``: XXH64 of ``key`` and the shard count decide. size is the text's
    UTF-8 bytes plus 1 (null: 1), text_crc32 its unsigned CRC-32 (null: of nothing).
    slot counts a shard's rows from 0 without gaps. grown_shard is the shard with one
    more. Null keys share one shard; repeated rows go where their key goes, each with
    a slot of its own. An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lean = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.xxhash64(key).alias("hash"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            keys = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            now, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            place = np.zeros(len(now), np.int64)
            for s in np.unique(now):
                own = np.flatnonzero(now == s)
                place[own] = seen[s] + np.arange(len(own))
                seen[s] += len(own)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(now), part, np.int32)), pa.array(now), pa.array(grown), pa.array(place)], names=["doc_id", "size", "text_crc32", "part", "shard", "grown_shard", "place"])

    placed = cut(lean.mapInArrow(run, f"doc_id {kind}, size long, text_crc32 long, part int, shard int, grown_shard int, place long"))
    # Rows by (partition, shard), not by document; a shard's offsets are a running sum over its partitions.
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write all columns of ``docs`` in folders ``shard=k`` under ``path``; a task writes to several folders and no shuffle is needed.

    Null texts and keys are written like any; an empty table writes no folder. A column
    named shard is refused, any other name is fine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("shard", pa.array(jump_hash(b.column(name).to_numpy(zero_copy_only=False).view(np.uint64), shards)))

    if "shard" in docs.columns:
        raise ValueError("documents already have a column shard")
    name = free_name(docs, "hash")
    hashed = docs.withColumn(name, F.xxhash64(key))
    out = hashed.mapInArrow(run, StructType([*hashed.schema.fields, StructField("shard", IntegerType())]))
    out.drop(name).write.partitionBy("shard").parquet(path)


def op6_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by doc_id."""
    return assign_shards(read_table(spark, sf_dir, "documents"))
