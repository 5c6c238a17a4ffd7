"""Places of rows in a global order, and values carried along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def _in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt by ranges of the order, sorted, and written to the shared folder, which fixes the places; __part is the range and __at the place, which grows along the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id of a row is its partition in the upper bits and its place there in the lower 33
    rows, _ = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    return rows.withColumn("__part", F.shiftright("__at", 33))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in the order of all rows; ties take different places.

    Rows are dealt by ranges and sorted within each; the counts of the ranges give the places before each, so the only window
    in one task has a row per range.
    """
    rows = _in_ranges(df, order, "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(bases), "__part").withColumn(name, place).drop("__at", "__part", "__base")


def carried(df: DataFrame, keys: list[str], order: list[Column], value: str, before: str, after: str) -> DataFrame:
    """df with the last value that is not null at or before each row of its key along order, and the first one at or after it.

    A key of any size is dealt over many tasks: rows are dealt by ranges of (keys, order), a window carries values within
    each range and key, and what lies beyond is carried from range to range over a table of one row for each range and key.
    The table of a key is as long as the key has ranges. Rows with a null key stay, as a key of their own.
    """
    rows = _in_ranges(df, [*(F.col(k) for k in keys), *order], "carried")
    own = [F.col("__part"), *(F.col(k) for k in keys)]
    w = Window.partitionBy(*own).orderBy("__at")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__b", F.last(value, True).over(back)).withColumn("__a", F.first(value, True).over(ahead))
    known = F.when(F.col(value).isNotNull(), F.col("__at"))
    ends = rows.groupBy(*own).agg(F.max_by(value, known).alias("__last"), F.min_by(value, known).alias("__first"))
    along = Window.partitionBy(*keys).orderBy("__part")
    ends = ends.select(*own, F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__far_b"), F.first("__first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__far_a"))
    ends = ends.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__far_b", "__far_a").where(F.col("__far_b").isNotNull() | F.col("__far_a").isNotNull())
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(ends, on, "left").withColumns({before: F.coalesce("__b", "__far_b"), after: F.coalesce("__a", "__far_a")})
    return out.select(*df.columns, before, after)
