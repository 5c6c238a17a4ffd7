"""Nearest, interval and lookup joins that plan as equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import carried


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, order: list[str], tolerance: float | None, left_id: list[str]) -> DataFrame:
    """Each left row with its nearest right row of the same keys, in either direction; equal distances go to the first by order.

    With a tolerance, time is cut into buckets of that length and every right row stands in its own and the two next to
    it, so the join is an equi-join of bounded fan-out. Without one, the last right row at or before and the first at or after
    are carried to every left row along both tables together (see ranks.carried), so no pairs are made and a key of any size
    is dealt over many tasks. Left rows without a match keep nulls.
    left_id names a row of left. Right columns other than keys must not clash with left's.
    """
    mine = [c for c in right.columns if c not in keys]
    if tolerance is not None:
        far = right.withColumn("__b", F.explode(F.array(*(F.floor(F.col(right_t) / tolerance) + d for d in (-1, 0, 1)))))
        near = left.withColumn("__b", F.floor(F.col(left_t) / tolerance)).join(far, [*keys, "__b"]).withColumn("__gap", F.abs(F.col(right_t) - F.col(left_t)))
        best = near.where(F.col("__gap") <= tolerance).groupBy(*keys, *(c for c in left_id if c not in keys)).agg(F.min_by(F.struct(*mine), F.struct("__gap", *order)).alias("__m"))
        on = list(dict.fromkeys([*keys, *left_id]))
        return left.join(best, on, "left").select(*left.columns, *(F.col("__m")[c].alias(c) for c in mine))
    both = left.select(*keys, F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*mine).alias("m")).schema["m"].dataType).alias("__m"), F.col(left_t).alias("__t"))
    both = both.unionByName(right.groupBy(*keys, F.col(right_t).alias("__t")).agg(F.min_by(F.struct(*mine), F.struct(*order)).alias("__m")), allowMissingColumns=True)
    found = carried(both, keys, [F.col("__t"), F.col("__l").isNotNull()], "__m", "__before", "__after").where(F.col("__l").isNotNull())
    gap_b, gap_a = F.abs(F.col("__t") - F.col("__before")[right_t]), F.abs(F.col("__after")[right_t] - F.col("__t"))
    first = F.struct(*(F.col("__before")[c] for c in order)) <= F.struct(*(F.col("__after")[c] for c in order))
    pick = F.when(F.col("__after").isNull() | (gap_b < gap_a) | ((gap_b == gap_a) & first), F.col("__before")).otherwise(F.col("__after"))
    pick = F.when(F.col("__before").isNull(), F.col("__after")).otherwise(pick)
    return found.withColumn("__pick", pick).select("__l.*", *(F.col("__pick")[c].alias(c) for c in mine))


def interval_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, start: str, end: str, width: float | None = None) -> DataFrame:
    """Points within the closed intervals of the same keys.

    Time is cut into buckets of the mean length of the windows (one aggregate of them, unless width is given), and a window
    stands in each bucket that it reaches: two for a window on average. So it is an equi-join, and a point meets only
    windows near it, however many its key has. Null times match nothing.
    """
    if width is None:
        width = windows.agg(F.avg(F.when(F.col(end) > F.col(start), F.col(end) - F.col(start)))).first()[0] or 1.0
    bucket = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    near = windows.where(F.col(start) <= F.col(end)).withColumn("__b", F.explode(bucket))
    return points.withColumn("__b", F.floor(F.col(t) / width)).join(near, [*keys, "__b"]).where(F.col(t).between(F.col(start), F.col(end))).drop("__b")


def own_interval(points: DataFrame, windows: DataFrame, keys: list[str], t: str, start: str, end: str) -> DataFrame:
    """Points within the closed interval of the same keys, where each key has but one: a point meets it by the keys alone, and what is grouped by them later is dealt already."""
    return points.join(windows, keys).where(F.col(t).between(F.col(start), F.col(end)))


def bucketed_after(causes: DataFrame, effects: DataFrame, keys: list[str], cause_t: str, effect_t: str, within: float) -> DataFrame:
    """Pairs with 0 < effect - cause <= within, by buckets of that length."""
    far = effects.withColumn("__b", F.explode(F.array(*(F.floor(F.col(effect_t) / within) + d for d in (-1, 0)))))
    near = causes.withColumn("__b", F.floor(F.col(cause_t) / within)).join(far, [*keys, "__b"]).drop("__b")
    gap = F.col(effect_t) - F.col(cause_t)
    return near.where((gap > 0) & (gap <= within))


def spike_response(spikes: DataFrame, peaks: DataFrame, keys: list[str], spike_t: str, peak_t: str, within: float = 0.5, each: list[str] | None = None) -> DataFrame:
    """Per key of spikes: whether a peak follows any spike in time, and the least delay, else 0. With each, further keys of peaks alone, per key of peaks."""
    both = [*keys, *(each or [])]
    delays = bucketed_after(spikes, peaks, keys, spike_t, peak_t, within).groupBy(*both).agg(F.min(F.col(peak_t) - F.col(spike_t)).alias("__d"))
    out = (peaks if each else spikes).select(*both).distinct().join(delays, both, "left")
    return out.select(*both, F.col("__d").isNotNull().alias("detected"), F.coalesce("__d", F.lit(0.0)).alias("delay"))


def before_after_means(points: DataFrame, series: DataFrame, keys: list[str], point_t: str, series_t: str, value: str, half: float = 0.5, each: list[str] | None = None) -> DataFrame:
    """Points with the mean of the series in [t - half, t] and in (t, t + half]; points that lack either side are left out. With each, per further key of the series."""
    far = points.withColumn("__b", F.explode(F.array(*(F.floor(F.col(point_t) / half) + d for d in (-1, 0, 1)))))  # a point is of all persons, a series of each
    near = far.join(series.withColumn("__b", F.floor(F.col(series_t) / half)), [*keys, "__b"])
    gap = F.col(series_t) - F.col(point_t)
    near = near.where((gap >= -half) & (gap <= half))
    own = [*points.columns, *(each or [])]
    out = near.groupBy(*own).agg(
        F.avg(F.when((gap >= -half) & (gap <= 0), F.col(value))).alias("before"), F.avg(F.when((gap > 0) & (gap <= half), F.col(value))).alias("after")
    )
    return out.where(F.col("before").isNotNull() & F.col("after").isNotNull())


def lookup_with_fallback(rows: DataFrame, dimension: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """value of dimension at key, else at the fallback key: two left joins, each of which Spark broadcasts if its size allows it."""
    one = dimension.select(F.col(key).alias("__k1"), F.col(value).alias("__v1"))
    two = dimension.select(F.col(key).alias("__k2"), F.col(value).alias("__v2"))
    out = rows.join(one, rows[key] == one["__k1"], "left").join(two, fallback == two["__k2"], "left")
    return out.select(*(rows[c] for c in rows.columns), F.coalesce("__v1", "__v2").alias(value))


def weighted_left_join(rows: DataFrame, weights: DataFrame, keys: list[str], weight: str, order: str, default: float = 1.0) -> DataFrame:
    """The weight of the first matching row by order, default where there is none or it is null."""
    first = weights.groupBy(*keys).agg(F.min_by(weight, order).alias(weight))
    return rows.join(first, keys, "left").withColumn(weight, F.coalesce(weight, F.lit(default)))


def unprocessed(every: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return every if force else every.join(done.select(key).distinct(), key, "left_anti")


def outer_fold(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of all tables on one key. Every table is dealt by the same key, so each is shuffled once."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), [t.where(F.col(key).isNotNull()) for t in tables])
