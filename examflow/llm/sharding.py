"""Sharding by longest processing time: groups stay together, loads are near equal.

Rows with equal text form a group. Groups heavier than 1/ITEMS of all bytes (so
at most ITEMS of them, however many groups there are) are items of their own;
all others are dealt by their digest to ITEMS buckets, and each bucket is one
item. A heap then gives the items, heaviest first, to the least-loaded shard.
So the driver holds at most 2 * ITEMS sums, and loads differ by at most the last
item a shard took, unless one group alone outweighs a shard.

* A null text has no bytes, size 1, and groups with other nulls (and apart from
  the empty text). Repeated rows count one by one. An empty table gives no rows.
* ``slot`` numbers the rows of a shard without gaps by hashed doc_id buckets.
* Ties: equal items in the order of their names, equal loads to the lower shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import dense_rank, partitions, written

ITEMS = 16_384


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """LPT: name -> shard for (name, load) items."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, load in sorted(items, key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (total + load, s))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, items: int = ITEMS) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, size, text_crc32, shard, slot, group_key."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("null")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("load"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("group_key"), F.lit(items))
    item = F.when(F.col("load") * items >= total, F.col("group_key")).otherwise(
        F.concat(F.lit("#"), bucket.cast("string"))
    )
    loads = groups.groupBy(item.alias("item")).agg(F.sum("load").alias("load"))
    # at most 2 * items rows, whatever the input
    placed = longest_first([(r.item, r.load) for r in loads.collect()], shards)
    plan = spark.createDataFrame(list(placed.items()), "item string, shard int")
    heavy = F.broadcast(plan.filter(~F.col("item").startswith("#")).select(
        F.col("item").alias("group_key"), F.col("shard").alias("own_shard")))
    light = F.broadcast(plan.filter(F.col("item").startswith("#")).select(
        F.expr("substring(item, 2)").cast("long").alias("b"), F.col("shard").alias("b_shard")))
    dealt = (
        rows.withColumn("b", bucket)
        .join(heavy, "group_key", "left").join(light, "b", "left")
        .withColumn("shard", F.coalesce("own_shard", "b_shard")).drop("b", "own_shard", "b_shard")
    )
    # a shard's rows in pieces of some thousands, so that no task sorts a shard
    n = max(partitions(spark), rows.count() // (shards * 8192) + 1)
    return dense_rank(dealt, ["shard"], F.struct("doc_id", "text_crc32"),
                      ["doc_id", "group_key"], "slot", n)
