"""Contiguous shards of near equal bytes, by global prefix sums.

Documents are put in order of doc_id by a range partitioning. Each partition sums up its own sizes; the partitions' totals,
one row each, give every partition its place in the whole; the whole is cut at equal targets. A document belongs to the
shard that its middle byte falls in, so a shard misses its target by no more than half a document at either end.

Defined cases: a null text has no bytes and the checksum 0. Null ids come first. Rows that repeat one doc_id stand side by
side, ordered by checksum and size. With fewer rows than shards some shards are empty; an empty table gives an empty
result. Other columns are ignored. At most ID_BYTES more than the text counts for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash

ID_BYTES = 16


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds each row's start in bytes and in rows within its partition."""
    start, row, part = 0, 0, TaskContext.get().partitionId()
    for batch in batches:
        ends = start + np.cumsum(batch["size"].to_numpy(dtype=np.int64))
        yield batch.assign(part=part, start=ends - batch["size"].to_numpy(dtype=np.int64), row=row + np.arange(len(batch)))
        if len(batch):
            start, row = int(ends[-1]), row + len(batch)


def byte_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 within the shard)."""
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ID_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = shuffle_partitions(spark)
    ranged = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stash(
        ranged.mapInPandas(_running, "doc_id long, size long, text_crc32 long, part int, start long, row long"), "ranged"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    middle = 2 * (F.col("byte_offset") + F.col("start")) + F.col("size")
    target = F.expr(f"least({shards - 1}, floor(middle / (2 * all_bytes / {shards})))")
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("middle", middle)
    placed = placed.select(*order, (F.col("row_offset") + F.col("row")).alias("row"), target.cast("int").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
