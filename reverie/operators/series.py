"""Ordered series: runs, gaps, sampling, velocity and oscillation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import r, signed_scalar
from ..functions.text import emotion_direction
from ..sources.shared import stored
from .ranks import ranked


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """df with run: 0, 1, ... as the state changes along order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__s", state)
    changed = F.when(F.lag("__s").over(w).isNull() | F.lag("__s").over(w).eqNullSafe(F.col("__s")), 0).otherwise(1)
    return marked.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w)).drop("__s", "__c")


def sustained(df: DataFrame, keys: list[str], t: str, on: Column) -> DataFrame:
    """Per key: seconds from first to last of the longest run on which the condition holds, 0 if it never does."""
    marked = runs(df, keys, [t], on).withColumn("__on", on)
    spans = marked.groupBy(*keys, "run").agg(F.when(F.first("__on"), F.max(t) - F.min(t)).otherwise(0.0).alias("__span"))
    return spans.groupBy(*keys).agg(F.max("__span").alias("sustained"))


def state_slices(df: DataFrame, keys: list[str], t: str, state: str, magnitude: str) -> DataFrame:
    """Slices between the runs of a state; keys with fewer than two samples give none.

    A run after the first gives a slice from the last time of the run before to its own last time; the first run gives one over
    itself if it has two samples. Each is classified by its own state, and signed by its last magnitude.
    """
    per_run = (
        runs(df, keys, [t], F.col(state))
        .groupBy(*keys, "run")
        .agg(F.count("*").alias("n"), F.min(t).alias("t0"), F.max(t).alias("t1"), F.max_by(magnitude, t).alias("mag"), F.first(state).alias("now"))
    )
    w = Window.partitionBy(*keys).orderBy("run")
    out = per_run.withColumn("t_before", F.lag("t1").over(w)).withColumn("was", F.lag("now").over(w)).where((F.col("run") > 0) | (F.col("n") >= 2))
    out = out.withColumn("start", F.coalesce("t_before", "t0")).withColumn("was", F.coalesce("was", "now"))
    direction = emotion_direction(F.col("now"))
    return out.select(
        *keys,
        F.row_number().over(w).alias("slice_id"),
        F.col("start").alias("slice_start"),
        F.col("t1").alias("slice_end"),
        F.col("was").alias("from_state"),
        F.col("now").alias("to_state"),
        r(F.col("mag"), 2).alias("terminal_magnitude"),
        direction.alias("direction"),
        r(signed_scalar(direction, F.col("mag")), 2).alias("scalar"),
    )


def history(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Each slice with the lines of the transitions so far."""
    line = F.format_string("%d. %s -> %s (Classified: %s)", F.col("slice_id"), "from_state", "to_state", "direction")
    w = Window.partitionBy(*keys).orderBy("slice_id").rowsBetween(Window.unboundedPreceding, 0)
    return slices.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def late_stage_score(slices: DataFrame, keys: list[str], climax: Column) -> DataFrame:
    """Mean of slice scalars weighted by length and by time since the climax (0.1 at least); 0 where nothing weighs."""
    weight = (F.col("slice_end") - F.col("slice_start")) * F.greatest(F.lit(0.1), F.col("slice_start") - climax)
    out = slices.withColumn("__w", weight).groupBy(*keys).agg(F.sum("__w").alias("__d"), F.sum(F.col("scalar") * F.col("__w")).alias("__n"))
    return out.select(*keys, F.when(F.col("__d") > 0, r(F.col("__n") / F.col("__d"), 2)).otherwise(0.0).alias("late_stage_score"))


def fixed_steps(start: Column, end: Column, step: float) -> Column:
    """start, start + step, ... up to end inclusive."""
    n = F.floor((end - start) / step + 1e-9).cast("int")
    return F.when(end >= start, F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step)).otherwise(F.array().cast("array<double>"))


def strided(frame: Column, fps: Column, rate: float) -> Column:
    return F.pmod(frame, F.greatest(F.lit(1), (fps / rate).cast("int"))) == 0


def evenly_picked(df: DataFrame, keys: list[str], t: str, least: int = 5, most: int = 20, per_second: float = 3.0) -> DataFrame:
    """At most clamp(int(3 * duration), 5, 20) rows of each key, evenly spaced by index, the last one among them."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("__i", F.row_number().over(w.orderBy(t)) - 1).withColumn("__n", F.count("*").over(w))
    x = x.withColumn("__k", F.greatest(F.lit(least), F.least(F.lit(most), ((F.max(t).over(w) - F.min(t).over(w)) * per_second).cast("int"))))
    wanted = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda j: F.when(j == F.col("__k") - 1, F.col("__n") - 1).otherwise((j * ((F.col("__n") - 1) / (F.col("__k") - 1))).cast("long")))
    return x.where((F.col("__n") <= F.col("__k")) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n", "__k")


def nan_interpolated(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Missing values by line between neighbours by index; ends hold the nearest value; with none at all, 0. filled: 1 where filled."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = df.withColumn("__i", F.row_number().over(w)).withColumn("__v", F.when(~F.isnan(F.col(value)), F.col(value)))
    known = F.when(F.col("__v").isNotNull(), F.struct("__i", "__v"))
    x = x.withColumn("__a", F.last(known, True).over(back)).withColumn("__b", F.first(known, True).over(ahead))
    a, b = F.col("__a"), F.col("__b")
    line = a["__v"] + (b["__v"] - a["__v"]) * (F.col("__i") - a["__i"]) / (b["__i"] - a["__i"])
    full = F.when(F.col("__v").isNotNull(), F.col("__v")).when(a.isNotNull() & b.isNotNull(), line).otherwise(F.coalesce(a["__v"], b["__v"], F.lit(0.0)))
    return x.withColumn("filled", F.col("__v").isNull().cast("int")).withColumn(value, full).drop("__i", "__v", "__a", "__b")


def median3(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Median of three in a row, zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b, c = F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.col(value), F.coalesce(F.lead(value).over(w), F.lit(0.0))
    return df.withColumn(value, F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def detrended(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def spikes(df: DataFrame, keys: list[str], value: str, share: float = 0.7, least: float = 3.0) -> DataFrame:
    """Rows above a share of their key's maximum, for keys whose maximum reaches least."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn("__top", top).where((F.col("__top") >= least) & (F.col(value) > share * F.col("__top"))).drop("__top")


def climax(df: DataFrame, keys: list[str], t: str, value: str, half: float = 1.0, coarse: int = 6) -> DataFrame:
    """Time of the largest value on every coarse-th sample, then of the largest sample within half a second band around it; the first of equals wins."""
    w = Window.partitionBy(*keys).orderBy(t)
    x = df.withColumn("__i", F.row_number().over(w) - 1)
    rough = x.where(F.pmod("__i", F.lit(coarse)) == 0).groupBy(*keys).agg(F.max_by(t, F.struct(value, -F.col(t))).alias("__c"))
    dense = df.join(rough, keys).where(F.abs(F.col(t) - F.col("__c")) <= half)
    return dense.groupBy(*keys).agg(F.max_by(t, F.struct(value, -F.col(t))).alias("climax"), F.max(value).alias("peak"))


def top_by_time(df: DataFrame, keys: list[str], t: str, value: str, k: int = 3) -> DataFrame:
    """The k largest of each key, numbered in time order."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc(), t))
    return df.withColumn("__r", best).where(F.col("__r") <= k).drop("__r").withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(t)))


def successive(samples: DataFrame, keys: list[str], t: str, point: str, x: str, y: str, most_gap: float = 0.5, **aggs: Column) -> DataFrame:
    """A row per sample (keys, t): moved, whether it shares a point with the sample before it, no longer than most_gap ago, velocity, and aggs over its points.

    Velocity is the mean distance of the points common to both, over the time between them. The points of a sample are one
    list, next to that of the sample before, so samples are shuffled once, and not at all if they are dealt by some of keys.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    points = F.collect_list(F.struct(F.col(point).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    rows = samples.groupBy(*keys, t).agg(points.alias("__now"), *(c.alias(n) for n, c in aggs.items())).withColumns({"__was": F.lag("__now").over(w), "__gap": F.col(t) - F.lag(t).over(w)})
    moves = F.flatten(F.transform("__now", lambda a: F.transform(F.filter("__was", lambda b: b["k"] == a["k"]), lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))
    rows = rows.withColumn("__d", F.when((F.col("__gap") > 0) & (F.col("__gap") <= most_gap), moves))
    known = F.filter("__d", lambda d: d.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, d: s + d) / F.size(known))
    return rows.select(*keys, t, F.coalesce(F.size("__d") > 0, F.lit(False)).alias("moved"), (mean / F.col("__gap")).alias("velocity"), *aggs)


def velocities(samples: DataFrame, keys: list[str], t: str, point: str, x: str, y: str, most_gap: float = 0.5) -> DataFrame:
    """Mean distance of the points common to successive samples, over the time between them; gaps over most_gap give none."""
    named = samples.dropna(subset=keys)
    return successive(named, keys, t, point, x, y, most_gap).where("moved").select(*keys, t, "velocity")


def central(cx: Column, cy: Column, low: float = 0.35, high: float = 0.65) -> Column:
    return cx.between(low, high) & cy.between(low, high)


def tail_centred(boxes: DataFrame, keys: list[str], t: str, start: str, end: str, cx: Column, cy: Column, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Whether a relative box centre lies in the central square during the last quarter of the window."""
    late = F.col(t).between(F.col(end) - 0.25 * (F.col(end) - F.col(start)), F.col(end))
    inside = central(cx, cy, low, high)
    return boxes.groupBy(*keys).agg(F.coalesce(F.bool_or(late & inside), F.lit(False)).alias("centred"))


def burst_sampled(df: DataFrame, keys: list[str], t: str, score: str, base: float = 1 / 8, burst: float = 1 / 16, jump: float = 0.3, hold: float = 2.0) -> DataFrame:
    """The samples that a scorer would take: every base seconds, every burst seconds for hold seconds after the score jumps.

    Which sample comes next depends on the scores before, so each key is walked in order; df holds scores on a fine grid.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, kind="stable")
        taken, due, until, last = [], -np.inf, -np.inf, None
        for i, (now, s) in enumerate(zip(pdf[t], pdf[score])):
            if now + 1e-9 < due:
                continue
            if last is not None and abs(s - last) > jump:
                until = now + hold
            taken.append((i, now <= until))
            due, last = now + (burst if now < until else base), s
        return pdf.iloc[[i for i, _ in taken]].assign(in_burst=[b for _, b in taken])

    return df.groupBy(*keys).applyInPandas(walk, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, in_burst boolean")


def _band(fps: float) -> tuple[float, float] | None:
    nyquist = fps / 2
    if nyquist > 3:
        return 1 / nyquist, 3 / nyquist
    if nyquist > 1.5:
        return max(0.01, 0.5 / nyquist), 0.99
    return None


def band_pass(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of the second-order Butterworth band-pass between two shares of the Nyquist frequency, by the bilinear transform with pre-warped edges."""
    edges = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
    prototype = np.exp(1j * np.pi * np.array([3, 5]) / 4) * width / 2
    root = np.sqrt(prototype**2 - centre**2)
    poles = np.concatenate([prototype + root, prototype - root])
    z = (4 + poles) / (4 - poles)
    gain = np.real(width**2 * 16 / np.prod(4 - poles))
    return gain * np.poly([1, 1, -1, -1]), np.real(np.poly(z))


def recursion(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A filter as a recursion of its state, and the state that a constant signal of 1 leaves: state -> step @ state + gain * x, and x comes out as b[0] * x + state[0]."""
    step = np.eye(len(a) - 1, k=1)
    step[:, 0] -= a[1:]
    gain = b[1:] - a[1:] * b[0]
    return step, gain, np.linalg.solve(np.eye(len(a) - 1) - step, gain)


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x filtered from a state, the state at its end).

    A block of samples takes a state to step^n @ state + what it leaves of no state, so all blocks are filtered from no state side
    by side, the states at their ends follow one from another, and what a state adds to its block is a product of matrices.
    """
    step, gain, _ = recursion(b, a)
    n = max(1, int(np.sqrt(len(x))))
    blocks = x[: len(x) // n * n].reshape(-1, n)
    out, held = np.empty_like(blocks), np.zeros((len(blocks), len(gain)))
    adds, power = np.empty((n, len(gain))), np.eye(len(gain))
    for i in range(n):
        out[:, i] = b[0] * blocks[:, i] + held[:, 0]
        held = held @ step.T + np.outer(blocks[:, i], gain)
        adds[i] = power[0]
        power = step @ power
    for k, left in enumerate(held):
        out[k] += adds @ state
        state = power @ state + left
    rest = np.empty(len(x) - out.size)
    for i, value in enumerate(x[out.size :]):
        rest[i] = b[0] * value + state[0]
        state = step @ state + gain * value
    return np.concatenate([out.ravel(), rest]), state


def filtered_all(b: np.ndarray, a: np.ndarray, xs: list[np.ndarray], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """filtered for many series at once. Those of one length go side by side, if that takes fewer steps than one after another."""
    step, gain, _ = recursion(b, a)
    out, left = [None] * len(xs), np.empty_like(states)
    lengths = np.array([len(x) for x in xs])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if len(at) < np.sqrt(n):
            for i in at:
                out[i], left[i] = filtered(b, a, xs[i], states[i])
            continue
        x, held = np.stack([xs[i] for i in at], 1), states[at].T
        y = np.empty_like(x)
        for i in range(n):
            y[i] = b[0] * x[i] + held[0]
            held = step @ held + np.outer(gain, x[i])
        left[at] = held.T
        for j, i in enumerate(at):
            out[i] = y[:, j]
    return out, left


def _ends(a: np.ndarray, b: np.ndarray) -> int:
    """By how many samples a series is continued at either end."""
    return 3 * max(len(a), len(b))


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of x, continued at both ends by its odd reflection, each pass from its steady state."""
    n = _ends(a, b)
    if len(x) <= n:
        raise ValueError(f"needs more than {n} samples")
    steady = recursion(b, a)[2]
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    for _ in range(2):
        y = filtered(b, a, y, steady * y[0])[0][::-1]
    return y[n:-n]


def zero_phase_series(df: DataFrame, keys: list[str], order: str, value: str, b: np.ndarray, a: np.ndarray, block_rows: int = 4096) -> DataFrame:
    """df with value filtered as by zero_phase along order, for series of any length; keys of too few samples give no rows.

    A series is dealt in blocks of block_rows samples. Each block leaves a state, and is otherwise an affine map of the state that
    it begins with; the maps of a series, a few numbers for each block, are composed in one small group, and then every
    block is filtered from the state that is its own, once forward and once backward. So a task holds one block, and the only
    rows of one key that meet are those of its blocks. order must not repeat within a key.
    """
    step, _, steady = recursion(b, a)
    n, width = _ends(a, b), len(steady)
    places = ranked(df.withColumn("__v", F.col(value).cast("double")), [*(F.col(k) for k in keys), F.col(order)], "__place")
    ends = places.groupBy(*keys).agg(F.min("__place").alias("__first"), F.count("*").alias("__n"), F.min_by("__v", "__place").alias("__head"), F.max_by("__v", "__place").alias("__tail"))
    rows = places.join(ends.where(F.col("__n") > n), keys).withColumn("__i", F.col("__place") - F.col("__first"))
    own = rows.select(*keys, (F.col("__i") + n).alias("i"), F.col("__v").alias("v"), F.col("__n").alias("n"))
    before = rows.where(F.col("__i").between(1, n)).select(*keys, (n - F.col("__i")).alias("i"), (2 * F.col("__head") - F.col("__v")).alias("v"), F.col("__n").alias("n"))
    back = F.col("__n") - 1 - F.col("__i")
    after = rows.where(back.between(1, n)).select(*keys, (n + F.col("__n") - 1 + back).alias("i"), (2 * F.col("__tail") - F.col("__v")).alias("v"), F.col("__n").alias("n"))
    blocks = own.union(before).union(after).groupBy(*keys, F.floor(F.col("i") / block_rows).alias("block")).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vs"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers: dict[int, np.ndarray] = {}
        for pdf in batches:
            begun = []
            for head, sizes, lefts in zip(pdf["head"], pdf["sizes"], pdf["lefts"]):
                state, own = steady * head, []
                for size, left in zip(sizes, lefts):
                    own.append(state)
                    if size not in powers:
                        powers[size] = np.linalg.matrix_power(step, int(size))
                    state = powers[size] @ state + left
                begun.append([x.tolist() for x in own])
            yield pdf[[*keys, "blocks"]].assign(states=begun)

    def passed(table: DataFrame, backward: bool) -> DataFrame:
        flip = slice(None, None, -1) if backward else slice(None)

        def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                xs = [np.asarray(v)[flip] for v in pdf["vs"]]
                left = filtered_all(b, a, xs, np.zeros((len(xs), width)))[1].tolist()
                yield pdf[[*keys, "block"]].assign(at=-pdf["block"] if backward else pdf["block"], head=[float(x[0]) for x in xs], size=[len(x) for x in xs], left=left)

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                xs = [np.asarray(v)[flip] for v in pdf["vs"]]
                begun = np.array([np.asarray(s) for s in pdf["state"]]).reshape(len(xs), width)
                yield pdf[[*keys, "block", "n"]].assign(vs=[y[flip].tolist() for y in filtered_all(b, a, xs, begun)[0]])

        maps = table.mapInPandas(leave, f"{named}, block long, at long, head double, size long, left array<double>")
        lists = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "block", "head", "size", "left"))).alias("m"))
        lists = lists.select(*keys, F.get("m", F.lit(0))["head"].alias("head"), F.col("m.block").alias("blocks"), F.col("m.size").alias("sizes"), F.col("m.left").alias("lefts"))
        begun = lists.mapInPandas(states, f"{named}, blocks array<long>, states array<array<double>>").select(*keys, F.explode(F.arrays_zip("blocks", "states")).alias("s"))
        begun = begun.select(*keys, F.col("s.blocks").alias("block"), F.col("s.states").alias("state"))
        return table.join(begun, [*keys, "block"]).select(*keys, "block", "n", "vs", "state").mapInPandas(apply, f"{named}, block long, n long, vs array<double>")

    table, _ = stored(blocks, "series-blocks")
    table, _ = stored(passed(table, False), "series-forward")
    out = passed(table, True).select(*keys, "n", "block", F.posexplode("vs").alias("p", "v")).withColumn("__i", F.col("block") * block_rows + F.col("p") - n)
    out = out.where((F.col("__i") >= 0) & (F.col("__i") < F.col("n"))).select(*keys, "__i", F.col("v").alias("__f"))
    return rows.join(out, [*keys, "__i"]).select(*(F.col("__f").alias(c) if c == value else F.col(c) for c in df.columns))


def prominent_peaks(x: np.ndarray, least: float) -> list[int]:
    """Middles of the plateaus higher than both neighbours that stand out by least above the higher of the lows to a higher point on either side.

    From a peak to the nearest higher point the series climbs on to a higher peak or an end, so only peaks and ends matter, and the
    lows between them: one pass from either side over a stack of ever higher peaks, each with the low behind it, finds all.
    """
    x = np.asarray(x, float)
    if len(x) < 3:
        return []
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    runs_ = x[starts]
    top = np.flatnonzero((runs_[1:-1] > runs_[:-2]) & (runs_[1:-1] > runs_[2:])) + 1
    if not len(top):
        return []
    at = np.concatenate([[0], starts[top], [len(x) - 1]])
    heights = x[at].tolist()
    lows = np.minimum.reduceat(x, at[:-1]).tolist()  # the low from each peak or end to the next
    lows[-1] = min(lows[-1], heights[-1])

    def low_to_higher(heights: list[float], gaps: list[float]) -> list[float]:
        """For each, the lowest point since the last higher one, or since the start."""
        out, stack = [], []
        for k, h in enumerate(heights):
            low = gaps[k - 1] if k else h
            while stack and stack[-1][0] <= h:
                low = min(low, stack.pop()[1])
            out.append(low)
            stack.append((h, low))
        return out

    left = low_to_higher(heights, lows)
    right = low_to_higher(heights[::-1], lows[::-1])[::-1]
    stops = np.append(starts[1:], len(x)) - 1
    return [int(starts[t] + stops[t]) // 2 for k, t in enumerate(top.tolist(), 1) if heights[k] - max(left[k], right[k]) >= least]


def oscillation(values: np.ndarray, fps: float) -> tuple[float, float]:
    """(Hz, confidence) of a head movement from evenly spaced angles."""
    x = np.asarray(values, float)
    if fps >= 32 and len(x) >= 3:
        padded = np.concatenate([[0], x, [0]])
        x = np.median(np.stack([padded[:-2], padded[1:-1], padded[2:]]), 0)
    x = x - x.mean()
    if band := _band(fps):
        x = zero_phase(*band_pass(*band), x)
    if x.std() < 0.02:
        return 0.0, 0.0
    extrema = len(prominent_peaks(x, 0.03)) + len(prominent_peaks(-x, 0.03))
    hz = extrema / 2 / (len(x) / fps)
    if extrema < 2 or not 0.5 <= hz <= 4:
        return hz, 0.0
    return hz, min(1.0, 0.5 + 0.1 * extrema) * min(1.0, float(np.sqrt((x**2).mean())) / 0.05)


def filled_by_index(x: np.ndarray) -> tuple[np.ndarray, float]:
    missing = np.isnan(x)
    if not missing.any():
        return x, 0.0
    if missing.all():
        return np.zeros_like(x), 1.0
    return np.interp(np.arange(len(x)), np.flatnonzero(~missing), x[~missing]), float(missing.mean())


def _oscillations_of(times: np.ndarray, pitch: np.ndarray, yaw: np.ndarray) -> tuple[float | None, ...]:
    """(Hz of pitch, Hz of yaw, confidence of pitch, confidence of yaw, share filled in) of a trace in order of time, None where it is too short."""
    span = times[-1] - times[0]
    if not (len(times) >= 5 and span > 0):
        return (None,) * 5
    n = max(5, int(span * (1 / np.diff(times).mean())))
    fps, grid = (n - 1) / span, np.linspace(times[0], times[-1], n)
    found, shares = [], []
    for x in (pitch, yaw):
        filled, share = filled_by_index(x)
        shares.append(share)
        found.append(oscillation(np.interp(grid, times, filled), fps) if n > 15 else (None, None))
    return found[0][0], found[1][0], found[0][1], found[1][1], max(shares)


def oscillations(traces: DataFrame, keys: list[str], t: str, pitch: str, yaw: str, least: int = 1) -> DataFrame:
    """Per key: nod and shake frequency and confidence after filling, even resampling and zero-phase filtering; traces too short to filter have none.

    Keys of fewer than least samples have no row. The rows of a key lie together in order of time, so a batch of rows holds many
    short traces, and a call of Python is no longer one per key; a trace longer than a batch is held alone.
    """
    values, names = ["__t", "__p", "__y"], ["pitch_hz", "yaw_hz", "pitch_conf", "yaw_conf", "interpolated"]
    w = Window.partitionBy(*keys).orderBy(*values)
    size = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = traces.select(*keys, *(F.col(c).cast("double").alias(n) for n, c in zip(values, (t, pitch, yaw))))
    rows = rows.withColumns({"__i": F.row_number().over(w), "__n": size}).where(F.col("__n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted = [], 1
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < wanted:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(table["__i"].to_numpy() == 1)
            sizes = table["__n"].to_numpy()[starts]
            ends = starts + sizes
            if ends[-1] > len(table):  # the last trace goes on in the next batch
                held, wanted = table.slice(starts[-1]).to_batches(), int(sizes[-1])
                starts, sizes, ends = starts[:-1], sizes[:-1], ends[:-1]
            else:
                held, wanted = [], 1
            if len(starts):
                x = [table[c].to_numpy() for c in values]
                found = zip(*(_oscillations_of(*(v[a:b] for v in x)) for a, b in zip(starts.tolist(), ends.tolist())))
                first = table.select(keys).take(pa.array(starts)).combine_chunks()
                own = [c.chunk(0) for c in first.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), *(pa.array(f, pa.float64()) for f in found)], names=[*keys, "n", *names])

    kinds = {f.name: f.dataType.simpleString() for f in traces.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, " + ", ".join(f"{c} double" for c in names)
    return rows.sortWithinPartitions(*keys, *values).mapInArrow(run, schema)
