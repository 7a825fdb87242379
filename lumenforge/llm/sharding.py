"""Contiguous shards of near equal bytes: prefix sums over a global order from per-partition totals, cut at equal targets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import columns_free, materialize, shared_dir, small_or_shuffled

SHARDS = 8


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *more,
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("order_key"),
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs; with the name of a column that tells rows apart, that too.

    The global order is by the text's hash, then doc_id (null first), so equal texts are neighbours and land in one shard
    unless a cut falls among them. A row's shard is the one whose share of all bytes holds the middle of the row; a text
    larger than a shard's share leaves that share's shard short or empty. Slots count a shard's rows from 0 in this order.
    Size is the text's UTF-8 bytes plus 1 (null: 1). Repeated rows each get a slot of their own. An empty table gives none.
    Only ids, sizes and hashes are sorted; the driver sees two numbers a partition and one a shard.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    more = [key] if key else []
    table = _sized(docs, *more).withColumnsRenamed({key: "row_key"} if key else {})
    by = ["order_key", "doc_id", *(["row_key"] if key else [])]
    # The sorted rows are written once, so that every later step finds the same rows in the same partition.
    table = table.select("doc_id", "size", "text_crc32", "order_key", *by[2:]).repartitionByRange(*by).sortWithinPartitions(*by).checkpoint()
    totals = table.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    bytes_at, rows_at, total, count = {}, {}, 0, 0
    for part, size, rows in sorted(totals):
        bytes_at[part], rows_at[part] = total, count
        total, count = total + size, count + rows

    def place(batches):
        part = TaskContext.get().partitionId()
        at, row = bytes_at.get(part, 0), rows_at.get(part, 0)
        for b in batches:
            size = b.column(1).to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(size)
            # Exact for any total: whole shares of (middle of the row) * shards / total, on Python integers where needed.
            middle = 2 * ends - size
            wide = total * shards * 2 >= 1 << 62
            shard = (middle.astype(object) * shards // (2 * total)).astype(np.int64) if wide else middle * shards // (2 * total)
            rows = row + np.arange(len(size), dtype=np.int64)
            if len(size):
                at, row = int(ends[-1]), int(rows[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *b.columns[4:], pa.array(np.minimum(shard, shards - 1).astype(np.int32)), pa.array(rows)], ["doc_id", "size", "text_crc32", *by[2:], "shard", "row"])

    placed = table.mapInArrow(place, "doc_id long, size long, text_crc32 long, " + ("row_key long, " if key else "") + "shard int, row long")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", *([F.col("row_key").alias(key)] if key else []), "shard", (F.col("row") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs, all rows and columns, with two more, named shard and slot (underscores appended on a clash).

    The rows are written once with a number of their own, by which each gets its place; so rows that are alike in all, or
    that have no id, don't meet in one task, and a task that runs again gives them the same places. Null text counts as a size
    of 1; an empty table gives no rows. Only numbers, sizes and hashes are sorted; texts move only if the places are too many
    to be broadcast.
    """
    shard, slot, key = columns_free(docs, "shard", "slot", "row_key")
    numbered = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "shard-rows")
    places = assign_shards(numbered, shards, key).select(key, F.col("shard").alias(shard), F.col("slot").alias(slot))
    return numbered.join(small_or_shuffled(materialize(places, "shard-places")), key).select(*[numbered[f"`{c}`"] for c in docs.columns], shard, slot)


def op9_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
