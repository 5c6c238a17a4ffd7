"""Contiguous shards of near-equal bytes by global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exclusive_bases, materialise, shuffle_partitions

_SCHEMA = "doc_id long, size long, text_crc32 long, part long, local_start long, local_row long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's byte offset and position within its range partition; rows arrive in order."""
    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = size_before + np.cumsum(size)
        n = len(size)
        if not n:
            continue
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("size"),
                batch.column("text_crc32"),
                pa.array(np.full(n, part, np.int64)),
                pa.array(ends - size),
                pa.array(rows_before + np.arange(n, dtype=np.int64)),
            ],
            names=["doc_id", "size", "text_crc32", "part", "local_start", "local_row"],
        )
        size_before, rows_before = int(ends[-1]), rows_before + n


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, row_overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in ascending doc_id order, into n_shards contiguous shards of near-equal bytes.

    A row weighs the UTF-8 bytes of its text plus row_overhead. One range shuffle of (doc_id, size, crc) orders the rows;
    the text itself never moves. Each partition sums its own sizes, the per-partition totals give every partition its base,
    and a row belongs to the shard of whose equal target its midpoint falls into, so a shard misses its target by less
    than one document at either end.

    Null text weighs row_overhead and has CRC 0; an empty text likewise. Null doc_ids come first. Rows that repeat (same or
    null doc_id) are kept, each with a place of its own, in the order of their texts' hashes, so a task that is run again
    gives the same places. A document longer than a
    target takes the shard of its midpoint, and shards may then stay empty. An empty table gives an empty result. Other
    columns are ignored.

    Returns doc_id, size, text_crc32, shard, slot (gapless in each shard, in doc_id order), byte_start (global offset).
    """
    spark = docs.sparkSession
    sized = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + row_overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(docs[text_col]).alias("h"),
    )
    ordered = sized.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = materialise(ordered.select("doc_id", "size", "text_crc32").mapInArrow(_running, _SCHEMA), "shard-rows")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = exclusive_bases(totals, "part", byte_base="bytes", row_base="rows")
    # one row per range partition, whose number is a setting: safe to broadcast
    total = totals.agg(F.coalesce(F.sum("bytes"), F.lit(1)).alias("total")).first()["total"]
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("byte_base") + F.col("local_start")).alias("byte_start"),
        (F.col("row_base") + F.col("local_row")).alias("row"),
    ).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * byte_start + size) * {n_shards}) div (2 * {total}L)")).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "byte_start"
    )
