"""Helpers shared by the training-data operators: table access, shared-folder materialisation, prefix sums over partitions."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or one under the warehouse where that is unset (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MADE: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and fixes the values of any order-dependent column."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for paths in _MADE:
        paths.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were materialised inside; what is returned from inside must have been written by then."""
    own: list[str] = []
    _MADE.append(own)
    try:
        yield
    finally:
        _MADE.remove(own)
        for path in own:
            delete(spark, path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialise returned and that nothing reads any more."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            delete(df.sparkSession, path)


#: A lookup table is broadcast up to this many rows of two numbers.
BROADCAST_ROWS = 500_000
#: A key is hot from so many rows on, and from this share of all rows: so there are at most 10,000 hot keys.
_HOT_ROWS, _HOT_SHARE = 128, 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", unique_rows: int | None = None) -> DataFrame:
    """rows joined with a table of one row for each key, whatever share of rows a key holds.

    A table of at most BROADCAST_ROWS rows is broadcast. Beyond that, the few hot keys of rows are met by a broadcast of
    their own rows of the table, at most 10,000 of them, and the others by a shuffle. rows and table are read more than once,
    so both should be materialised. how is inner or left; null keys match nothing.
    """
    if (table.count() if unique_rows is None else unique_rows) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = materialise(counts.where(F.col("count") > max(_HOT_ROWS, rows.count() // _HOT_SHARE)).select(key), "hot-keys")
    if not hot.limit(1).count():
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_anti").join(table, key, how).unionByName(rows.join(hot, key, "left_semi").join(few, key, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exclusive_bases(parts: DataFrame, key: str, **totals: str) -> DataFrame:
    """Exclusive prefix sums of per-partition totals: one row per partition, so the single window task reads as many rows as there are partitions."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, *(F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base) for base, total in totals.items()))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with place: the number of each row, from 0, in the order of all rows; rows that agree in it take different places.

    Rows are dealt by ranges of the order and sorted within each; the counts of the ranges give the places before them, so
    the only window in one task has a row per range. The sorted rows are written to the shared folder, which fixes their places.
    """
    n = shuffle_partitions(df.sparkSession)
    # the id of a row is its partition in the upper bits and its place there in the lower 33
    rows = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    bases = exclusive_bases(rows.groupBy("__part").agg(F.count("*").alias("__n")), "__part", __base="__n")
    place = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(bases), "__part").withColumn("place", place).drop("__at", "__part", "__base")


def give_back(spark: SparkSession) -> None:
    """Has the executors and the driver collect their garbage, so that heaps that grew in a stage before shrink to what is alive.

    A heap stays at the most it ever held although hardly any of it is alive, which leaves the Python processes beside
    it the less room the longer a session runs. One small task for each core asks for it; it changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    trim()
    spark._jvm.System.gc()


def read_columns(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, so that whatever else docs carries cannot clash with working names."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), *(docs[c] for c in cols))


_Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Gives what this Python process no longer holds back to the system; the allocator keeps freed pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if back:
        back(0)


def released(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """run, after which the worker gives what it no longer holds back to the system: Python workers live on for later stages, and the allocator keeps freed pages."""

    @wraps(run)
    def wrapped(batches: _Batches) -> _Batches:
        yield from run(batches)
        trim()

    return wrapped
