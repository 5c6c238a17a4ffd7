"""The layers as steps with declared inputs, run in the order of their dependencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import delete, stored
from . import export, records
from . import layers as L


@dataclass(frozen=True)
class Step:
    """A table made from other tables, by name. build takes those of reads and then those of optional (None where missing).

    required are those of reads that must hold rows, or the run fails. A layer gives one record for each recording and
    takes part in the export; other steps are tables that layers share.
    """

    name: str
    build: Callable[..., DataFrame]
    reads: tuple[str, ...]
    optional: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    layer: bool = True


#: Tables that the manifest gives; every other input of a step is an observation table, or a step.
FROM_MANIFEST = ("recordings", "tasks", "persons", "boxes")
STEPS = (
    Step("trace", L.attention, ("gaze", "boxes", "intrinsics"), layer=False),
    Step("keypoints", L.body_keypoints, ("poses",), layer=False),
    Step("03a_attention", records.attention, ("trace", "persons")),
    Step("traces", records.traces, ("03a_attention",), layer=False),
    Step("03b_reasonable_emotion", records.emotion, ("emotions", "tasks", "persons"), optional=("03a_attention",)),
    Step("03c_acoustic_prosody", lambda tasks, recordings, audio: records.prosody(audio, tasks, recordings), ("tasks", "recordings"), optional=("audio",)),
    Step("03d_proxemic_kinematics", records.proxemics, ("recordings", "tasks", "persons", "boxes", "depth", "noise")),
    Step("03e_affirmation_gesture", records.gesture, ("recordings", "tasks", "persons", "traces"), required=("traces",)),
    Step("03f_motor_resonance", records.resonance, ("recordings", "tasks", "persons", "flow", "keypoints")),
    Step("03g_shared_reality", records.shared_reality, ("recordings", "tasks", "boxes", "flow")),
)


def needed(steps: Iterable[Step], given: Iterable[str], wanted: Iterable[str] | None = None) -> list[Step]:
    """The wanted steps (all, unless told) and those that they read, each after what it reads. Optional inputs count where they can be had.

    A table that is neither given nor made raises KeyError with the step that misses it; a circle raises graphlib.CycleError.
    """
    by_name, have = {s.name: s for s in steps}, set(given)
    graph: dict[str, set[str]] = {}
    todo = list(by_name) if wanted is None else list(wanted)
    while todo:
        name = todo.pop()
        if name in graph or name in have:
            continue
        if name not in by_name:
            raise KeyError(name)
        step = by_name[name]
        for read in step.reads:
            if read not in have and read not in by_name:
                raise KeyError(f"{name} cannot run: {read} is missing")
        optional = [o for o in step.optional if o in have or (o in by_name and _possible(by_name, have, o))]
        graph[name] = {r for r in (*step.reads, *optional) if r not in have}
        todo += graph[name]
    return [by_name[n] for n in TopologicalSorter(graph).static_order()]


def _possible(by_name: Mapping[str, Step], have: set[str], name: str, above: frozenset[str] = frozenset()) -> bool:
    if name in have:
        return True
    return name in by_name and name not in above and all(_possible(by_name, have, r, above | {name}) for r in by_name[name].reads)


@contextmanager
def run(spark: SparkSession, tables: Mapping[str, DataFrame], wanted: Iterable[str] | None = None, steps: Iterable[Step] = STEPS) -> Iterator[dict[str, DataFrame]]:
    """The tables of the wanted steps and of all that they read, by name; for use in a with block, at whose end what was stored is deleted.

    Every table that more than one step reads, given or made, is written to the shared folder once and read from there, and so
    is one that must hold rows, which is asked once; a step's other inputs stay lazy, so filters and columns reach their scans.
    """
    order = needed(steps, tables, wanted)
    readers = Counter(r for s in order for r in dict.fromkeys((*s.reads, *s.optional)))
    required = {r for s in order for r in s.required}
    out, paths = dict(tables), []

    def settle(name: str) -> None:
        if readers[name] > 1 or name in required:
            out[name], path = stored(out[name], f"step-{name}")
            paths.append(path)

    try:
        for name in tables:
            if readers[name]:
                settle(name)
        for step in order:
            for name in step.required:
                L.require(out.get(name), step.name, name)
            out[step.name] = step.build(*(out[r] for r in step.reads), *(out.get(o) for o in step.optional))
            settle(step.name)
        yield out
    finally:
        for path in paths:
            delete(spark, path)


def export_rows(spark: SparkSession, manifest: DataFrame, tables: Mapping[str, DataFrame], path: str, wanted: Iterable[str] | None = None, corrected: bool = False) -> DataFrame:
    """From a manifest and observation tables to the wide row of every recording, written to path and read from there.

    Layers whose inputs are not there are left out unless wanted names them; a layer whose required table is empty fails the run.
    """
    given = {name: df for name, df in records.observations(manifest).items() if name not in tables} | dict(tables)
    by_name = {s.name: s for s in STEPS}
    layers = [s.name for s in STEPS if s.layer and _possible(by_name, set(given), s.name)] if wanted is None else list(wanted)
    with run(spark, given, layers) as made:
        export.wide_rows(manifest, {name: made[name] for name in layers}, corrected).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
