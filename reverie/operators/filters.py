"""Filters and gates of the intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions.text import collapsed, holds_any
from .ranks import ranked


def supported(dataset: Column, names: tuple[str, ...] = C.SUPPORTED_DATASETS) -> Column:
    return F.lower(F.trim(F.coalesce(dataset, F.lit("")))).isin(*names)


def likely_solo(scenarios: Column) -> Column:
    """True if there are scenarios and every one holds a solo phrase."""
    every = F.forall(scenarios, lambda s: holds_any(collapsed(s), C.SOLO_SCENARIOS))
    return F.coalesce((F.size(scenarios) > 0) & every, F.lit(False))


def wearer_artifact(y1: Column, y2: Column, height: Column) -> Column:
    """Boxes that are the camera wearer's own body: low and tall, or from the top edge nearly to the bottom."""
    return ((y2 > 0.95 * height) & (y1 > 0.15 * height)) | ((y1 == 0) & (y2 > 0.90 * height))


def head_and_shoulder(conf: Column, least: float = 0.3) -> Column:
    head = F.exists(F.slice(conf, 1, 5), lambda c: c >= least)
    shoulder = F.exists(F.slice(conf, 6, 2), lambda c: c >= least)
    return F.coalesce(head & shoulder, F.lit(False))


def consistent(detections: DataFrame, key: str, frame: str, least: int = 2, enforced: bool = True) -> DataFrame:
    """Detections of keys that have them in at least so many frames; without enforcement, all."""
    if not enforced:
        return detections
    enough = detections.groupBy(key).agg(F.countDistinct(frame).alias("__n")).where(F.col("__n") >= least).select(key)
    return detections.join(enough, key, "left_semi")


def confirmed(answers: DataFrame, key: str, order: str, yes: Column, budget: int = 5, least: int = 2) -> DataFrame:
    """Keys confirmed by at least so many of their first answers."""
    first = answers.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__r") <= budget)
    return first.groupBy(key).agg(F.count_if(yes).alias("yes")).select(key, "yes", (F.col("yes") >= least).alias("confirmed"))


def first_verdict(answers: DataFrame, key: str, order: str, verdict: str) -> DataFrame:
    return answers.groupBy(key).agg(F.min_by(verdict, order).alias(verdict))


def valid_tasks(labels: Column) -> Column:
    trimmed = F.transform(labels, lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: (x != "") & ~F.lower(x).isin(*C.INVALID_TASKS))


def enough_points(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def gaze_threshold(model: Column) -> Column:
    out = F.lit(0.3)
    for name, value in C.GAZE_THRESHOLDS.items():
        out = F.when(model == name, F.lit(value)).otherwise(out)
    return out


def chin_gate(y2: Column, height: Column, face_up: Column) -> Column:
    """False for boxes that reach into the lowest fifth and whose face is confirmed to look up: the wearer's own. No answer keeps a box."""
    return ~((y2 > 0.80 * height) & F.coalesce(face_up, F.lit(False)))


def sound_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 > x1) & (y2 > y1)


def purge(decision: Column) -> Column:
    """A recording is kept where the decision is missing."""
    return F.coalesce(decision, F.lit(True))


def pose_pick(candidates: DataFrame, keys: list[str], order: str, overlap: str, spread: str) -> DataFrame:
    """One candidate for each key: the only one; else that of largest overlap if every one has a box; else that of largest keypoint spread.

    Equals go to the first by order, and so does a key none of whose candidates shows a keypoint (null spread).
    """
    w = Window.partitionBy(*keys)
    boxed = F.count(overlap).over(w) == F.count("*").over(w)
    score = F.when(boxed, F.col(overlap)).otherwise(F.coalesce(F.col(spread), F.lit(-1.0)))
    ranked_rows = candidates.withColumn("__s", score).withColumn("__r", F.row_number().over(w.orderBy(F.col("__s").desc(), order)))
    return ranked_rows.where(F.col("__r") == 1).drop("__r", "__s")


def batches(rows: DataFrame, order: str, free_bytes: int, item_bytes: int = 500_000_000, group: list[str] | None = None) -> DataFrame:
    """Rows numbered into batches of clamp(free / item, 10, 500), within each group if one is given.

    Without a group the places are global (see ranked), so no task gets all rows.
    """
    size = max(10, min(500, free_bytes // item_bytes))
    if not group:
        placed = ranked(rows, [F.col(order).asc()], "__place")
        return placed.withColumn("batch", F.floor((F.col("__place") - 1) / size)).drop("__place")
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
