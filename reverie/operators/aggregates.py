"""Aggregates with first-wins ties, and registry-driven summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType

from ..functions import constants as C
from ..functions.maths import r, spine_angle
from ..sources.shared import stored


def first_max_by(value: Column, score: Column, order: Column) -> Column:
    """value at the largest score, the first by order on ties."""
    return F.max_by(value, F.struct(score, -order))


def max_abs(value: Column, order: Column) -> Column:
    """The signed value of largest magnitude, the first by order on ties."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(F.abs(value), -order)))


def truthy(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return value
    if kind == "string":
        return value != ""
    return value != 0


def summary(path: str, agg: str, suffix: str, item: Column, kind: str, order: Column) -> Column:
    """One aggregate of the registry over exploded items. Unknown names raise when the plan is built."""
    if agg == "mean":
        return r(F.avg(item), 4).alias(suffix)
    if agg == "max":
        return F.max(item).alias(suffix)
    if agg == "max_abs":
        return max_abs(item, order).alias(suffix)
    if agg == "any":
        return F.bool_or(truthy(item, kind)).alias(suffix)
    if agg.startswith("any_eq:"):
        return F.bool_or(item == F.lit(agg.removeprefix("any_eq:"))).alias(suffix)
    raise ValueError(f"unknown aggregate {agg!r} for {path!r}")


def summarise(layer: DataFrame, name: str, key: str = "video_id", corrected: bool = False) -> DataFrame:
    """The registry's summaries of one layer's nested results: a row per key. Paths that the schema lacks give no column.

    Each level is exploded once and aggregated once, so a summary costs one shuffle for tasks and one for persons.
    """
    wanted = [(p, C.CORRECTED_ACTIONS.get(a, a) if corrected else a, s) for p, a, s in C.SUMMARIES.get(name, [])]
    tasks_type = layer.schema["tasks_analyzed"].dataType.elementType
    tasks = layer.select(key, F.posexplode("tasks_analyzed").alias("ti", "task"))
    levels = [("", tasks, tasks_type, F.col("ti"), "task")]
    if "per_person" in tasks_type.names and isinstance(tasks_type["per_person"].dataType, ArrayType):
        people = tasks.select(key, "ti", F.posexplode("task.per_person").alias("pi", "person"))
        levels.append(("per_person.", people, tasks_type["per_person"].dataType.elementType, F.struct((-F.col("ti")).alias("t"), (-F.col("pi")).alias("p")), "person"))
    parts = []
    for prefix, rows, kind, order, column in levels:
        own = [(p.removeprefix(prefix), a, s) for p, a, s in wanted if p.startswith(prefix) and ("." in p) == bool(prefix)]
        own = [(p, a, s) for p, a, s in own if isinstance(kind, StructType) and p in kind.names and _fits(kind[p].dataType, a)]
        if own:
            aggs = []
            for p, a, s in own:
                item = F.col(column)[p]
                if a == "max_abs":
                    aggs.append(F.max_by(item, F.when(item.isNotNull(), F.struct(F.abs(item), -order if not prefix else order))).alias(s))
                else:
                    aggs.append(summary(p, a, s, item, kind[p].dataType.simpleString(), F.lit(0)))
            parts.append(rows.groupBy(key).agg(*aggs))
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts) if parts else layer.select(key).limit(0)


def _fits(kind, agg: str) -> bool:
    return agg.startswith("any") or (isinstance(kind, NumericType) and not isinstance(kind, BooleanType))


def tracks(detections: DataFrame, keys: list[str], t: str, box: list[str], conf: str) -> DataFrame:
    """Co-indexed arrays of times, boxes and confidences per person, in time order."""
    rows = F.array_sort(F.collect_list(F.struct(t, *box, conf)))
    out = detections.groupBy(*keys).agg(rows.alias("__r"))
    return out.select(
        *keys,
        F.transform("__r", lambda x: x[t]).alias("timestamps_sec"),
        F.transform("__r", lambda x: F.array(*(x[b] for b in box))).alias("bounding_boxes"),
        F.transform("__r", lambda x: x[conf]).alias("detection_confidence"),
    )


def exploded_tracks(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """The reverse: a row per sample; arrays of unequal lengths give none."""
    same = (F.size("timestamps_sec") == F.size("bounding_boxes")) & (F.size("timestamps_sec") == F.size("detection_confidence"))
    rows = manifest.where(same).select(*keys, F.posexplode(F.arrays_zip("timestamps_sec", "bounding_boxes", "detection_confidence")).alias("i", "x"))
    box = F.col("x.bounding_boxes")
    return rows.select(*keys, "i", F.col("x.timestamps_sec").alias("t"), *(F.get(box, j).alias(n) for j, n in enumerate(("x1", "y1", "x2", "y2"))), F.col("x.detection_confidence").alias("conf"))


def dominant(df: DataFrame, keys: list[str], value: str, order: str, ignored: str = "Unknown") -> DataFrame:
    """The commonest value of each key but the ignored one, the one seen first on ties; the ignored one if there is no other."""
    counts = df.where(F.col(value) != ignored).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(first_max_by(F.col(value), F.col("n"), F.col("first")).alias("dominant"))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn("dominant", F.coalesce("dominant", F.lit(ignored)))


def area_delta(df: DataFrame, keys: list[str], t: str, area: Column) -> DataFrame:
    """Percent from the first to the last area in time; null under two samples, 0 where the first is not positive."""
    out = df.withColumn("__a", area).groupBy(*keys).agg(F.min_by("__a", t).alias("a0"), F.max_by("__a", t).alias("a1"), F.count("*").alias("n"))
    return out.select(*keys, F.when(F.col("n") >= 2, F.when(F.col("a0") > 0, (F.col("a1") - F.col("a0")) / F.col("a0") * 100).otherwise(0.0)).alias("area_delta_pct"))


def slope_span(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Least-squares slope times the span of time; null under two samples or without a span."""
    span = F.max(t) - F.min(t)
    return df.groupBy(*keys).agg(F.when((F.count("*") >= 2) & (span > 0), F.regr_slope(value, t) * span).alias("delta"))


def peak_of(t: str, value: str) -> list[Column]:
    """Aggregates peak and peak_t: the largest positive value and its first time, null if there is none."""
    moving = F.col(value) > 0
    return [F.max(F.when(moving, F.col(value))).alias("peak"), F.max_by(t, F.when(moving, F.struct(value, -F.col(t)))).alias("peak_t")]


def velocity_peak(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(*keys).agg(*peak_of(t, value))


def camera_shift(df: DataFrame, keys: list[str], dx: str, dy: str, upscale: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg(r(F.sum(-F.col(dx) * upscale), 2).alias("shift_x"), r(F.sum(-F.col(dy) * upscale), 2).alias("shift_y"))


def normalised_variance(df: DataFrame, keys: list[str], value: str, divisor: float = 10_000.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.count(value) > 1, F.least(F.lit(1.0), F.var_pop(value) / divisor)).otherwise(0.0).alias("variance"))


def mirroring(flow: DataFrame, angles: DataFrame, keys: list[str], flow_t: str, vertical: str, angle_t: str, angle: str, half: float = 0.5, each: list[str] | None = None) -> DataFrame:
    """The first downward point whose body angle changes around it: detected and scalar. With each, further keys of angles alone, per key of angles."""
    from .joins import before_after_means

    both = [*keys, *(each or [])]
    points = flow.where(F.col(vertical) < -1.0).select(*keys, flow_t)
    means = before_after_means(points, angles, keys, flow_t, angle_t, angle, half, each)
    change = F.abs(F.col("after") - F.col("before"))
    first = means.where(change > 0.1).groupBy(*both).agg(F.min_by(change, flow_t).alias("__d"))
    out = (angles if each else flow).select(*both).distinct().join(first, both, "left")
    return out.select(*both, F.col("__d").isNotNull().alias("mirroring_detected"), F.least(F.lit(1.0), F.coalesce("__d", F.lit(0.0)) / 0.5).alias("mirroring_scalar"))


def spine_means(point: str, x: str, y: str) -> list[Column]:
    """Aggregates of the points of a sample: mean shoulder (points 5 and 6) and mean hip (11 and 12), x and y of each."""

    def mean(points: tuple[int, int], value: str) -> Column:
        return F.avg(F.when(F.col(point).isin(*points), F.col(value)))

    return [mean(points, value) for points in ((5, 6), (11, 12)) for value in (x, y)]


def spine_angles(samples: DataFrame, keys: list[str], t: str, point: str, x: str, y: str) -> DataFrame:
    """Angle of the line from the mean hip to the mean shoulder of each sample that shows at least one of either (points 5 and 6, 11 and 12)."""
    names = ["__sx", "__sy", "__hx", "__hy"]
    means = samples.groupBy(*keys, t).agg(*(c.alias(n) for n, c in zip(names, spine_means(point, x, y))))
    return means.select(*keys, t, spine_angle(*map(F.col, names)).alias("angle")).where(F.col("angle").isNotNull())


#: Long keys that are met by broadcast; each of the others has at most so small a part of all rows.
_HOT_KEYS = 1_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], names: list[str], few: int = 100_000, bins: int = 256) -> DataFrame:
    """Exact percentiles of each key, by line between the two order statistics next to it; null where a key has no value.

    Keys of at most few rows are left to the built-in percentile, which holds the distinct values of a key. For longer ones the
    statistics are selected by narrowing histograms: each round counts, for each key and statistic, the values of its range in
    bins, and the bin that holds it, from its least to its greatest value, is the range of the next round, until that is one value
    or has at most few, which are ranked. Counts are combined before the shuffle, so no task holds the values of a long key.
    Rounds read df again, so it should be a table. NaNs count as larger than any number.
    """
    rows = df.select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v"))
    sizes, _ = stored(rows.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "percentiles-sizes")
    long = sizes.where(F.col("n") > few)
    n_long, total = long.count(), sizes.agg(F.sum("n")).first()[0] or 0
    near = F.broadcast if n_long <= _HOT_KEYS else (lambda x: x)
    short = rows.join(near(long.select("k")), "k", "left_anti") if n_long else rows
    out = short.groupBy("k").agg(*(F.percentile("v", s).alias(n) for s, n in zip(shares, names)))
    if n_long:
        out = out.unionByName(_selected(rows, long, shares, names, few, bins, max(few, total // _HOT_KEYS)))
    return out.select("k.*", *names)


def _log_scale(x: Column) -> Column:
    """A scale on which doubles of all sizes, of either sign, are spread evenly."""
    return F.when(F.abs(x) > 1e-320, F.signum(x) * (F.ln(F.least(F.abs(x), F.lit(1.7e308))) + 740)).otherwise(0.0)


def _selected(rows: DataFrame, long: DataFrame, shares: list[float], names: list[str], few: int, bins: int, hot: int) -> DataFrame:
    """k and the percentiles of the long keys (k, n, low, high) of rows (k, v); those of more than hot rows are met by broadcast."""
    ends = [F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares]
    open_ = long.select("k", F.explode(F.array_distinct(F.concat(*ends))).alias("place"), "n", "low", "high").withColumns({"rank": F.col("place"), "count": F.col("n")})
    found = None

    def within(targets: DataFrame) -> DataFrame:
        wide, narrow = targets.where(F.col("n") > hot), targets.where(F.col("n") <= hot)
        met = rows.join(F.broadcast(wide), "k").unionByName(rows.join(narrow, "k"))
        return met.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    while True:
        open_, _ = stored(open_, "percentiles-open")
        single = F.col("low") == F.col("high")
        order = Window.partitionBy("k", "place").orderBy("v")
        last = within(open_.where(~single & (F.col("count") <= few))).withColumn("at", F.row_number().over(order) - 1).where(F.col("at") == F.col("rank"))
        done = open_.where(single).select("k", "place", F.col("low").alias("v")).unionByName(last.select("k", "place", "v"))
        found = done if found is None else found.unionByName(done)
        left = open_.where(~single & (F.col("count") > few))
        if left.isEmpty():
            break
        wide = (F.col("low") <= 0) & (F.col("high") >= 0) | (F.greatest(F.abs("low"), F.abs("high")) > 16 * F.least(F.abs("low"), F.abs("high")))
        scaled = [F.when(wide, _log_scale(F.col(c))).otherwise(F.col(c)) for c in ("v", "low", "high")]
        share = F.nanvl((scaled[0] - scaled[1]) / (scaled[2] - scaled[1]), F.lit(0.0))
        bin_ = F.when(F.col("v") == F.col("high"), bins).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")))  # the greatest value has a bin of its own, so every round narrows
        counts = within(left).groupBy("k", "place", "n", "rank", bin_.alias("bin")).agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("count").over(Window.partitionBy("k", "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        picked = counts.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count")))
        open_ = picked.select("k", "place", "n", "low", "high", (F.col("rank") - F.col("before")).alias("rank"), "count")
    values = found.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at")).join(long.select("k", "n"), "k")

    def line(s: float) -> Column:
        at = F.lit(s) * (F.col("n") - 1)
        lo, hi = F.element_at("at", F.floor(at)), F.element_at("at", F.ceil(at))
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return values.select("k", *(line(s).alias(n) for s, n in zip(shares, names)))


def masked_median(df: DataFrame, keys: list[str], value: str, mask: Column, scale: float = 255.0) -> DataFrame:
    """Exact median of the values under the mask over scale; of all values where the mask of a key is empty."""
    masked = df.withColumn("__under", F.when(mask, F.col(value).cast("double")))
    under, every = percentiles(masked, keys, "__under", [0.5], ["__m"]), percentiles(df, keys, value, [0.5], ["__all"])
    return every.join(under, keys, "left").select(*keys, (F.coalesce("__m", "__all") / scale).alias("median"))


def resident_bytes(models: DataFrame, tier: str) -> DataFrame:
    """Sum of the known sizes of one tier."""
    return models.where(F.col("tier") == tier).agg(F.sum("bytes").alias("bytes"))


def fold_error(errors: DataFrame, fold: str, epoch: str, error: str) -> DataFrame:
    """Mean over folds of each epoch, and the epoch of the least mean, the first of equals."""
    means = errors.groupBy(fold, epoch).agg(F.avg(error).alias("e")).groupBy(epoch).agg(F.avg("e").alias("mean_error"))
    return means.agg(F.min_by(epoch, F.struct("mean_error", epoch)).alias("best_epoch"), F.min("mean_error").alias("best_error"))
