"""Assigning documents to shards by jump consistent hashing, in DataFrame functions only.

The law is `key`: doc_id and the shard count decide. Jump hashing walks a pseudo-random sequence of ever larger bucket
numbers that depends on the key alone and takes the last one below the shard count, so one more shard takes only rows
into itself, and no ring or table is stored. The sequence's draws are xxhash64(doc_id, step), as uniform numbers in
(0, 1]; the next bucket after b is floor((b + 1) / draw). It rises with every step; about ln(shards) steps end the walk,
some four times as many are taken by default, and the few rows that need more go on until they are there.

A row's slot is its number within the shard, from 0 without gaps. Shards are large, so rows are numbered within hashed
buckets of a shard, and bucket sizes are summed up; the row's place in the written table is part of the hash, so that a
doc_id which holds a third of all rows is spread as well.

Null doc_id is a key like others (all such rows share a shard); null text counts as empty. Rows that repeat get a slot
each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import let, materialise

#: Rows that a bucket of a shard should have at most.
_BUCKET_ROWS = 50_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key."""

    def step(state: Column, i: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, i), 11) + 1) / F.lit(float(1 << 53))
        after = F.struct(state["next"].alias("at"), F.floor((state["next"] + 1) / draw).cast("double").alias("next"))
        return F.when(state["next"] < shards, after).otherwise(state)

    walk = lambda state, first, end: F.aggregate(F.sequence(F.lit(first), F.lit(end - 1)), state, step)
    few = min(shards, 16 + 4 * math.ceil(math.log(shards)))
    near = walk(F.struct(F.lit(-1.0).alias("at"), F.lit(0.0).alias("next")), 0, few)
    if few == shards:
        return near["at"].cast("int")
    return let(near, lambda s: F.when(s["next"] >= shards, s["at"]).otherwise(walk(s, few, shards)["at"])).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard if there were one more) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = materialise(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            jump_hash(key, shards).alias("shard"),
            jump_hash(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    buckets = max(256, rows.count() // (shards * _BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "place"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket")
    bases = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "place")
    numbered = rows.withColumn("number", F.row_number().over(within)).join(bases, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("number") - 1).alias("slot"), "grown_shard")
