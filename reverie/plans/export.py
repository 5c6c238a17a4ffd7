"""The wide export row: one per recording, with every layer's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import joined_labels
from ..operators.aggregates import summarise
from ..operators.joins import outer_fold

KEY = "video_id"


def base_rows(manifest: DataFrame) -> DataFrame:
    """video_id, source_dataset, task_labels, duration_sec and fps; records without an id are left out."""
    key = F.coalesce(*(F.col(c) for c in ("id", KEY) if c in manifest.columns))
    labels = joined_labels(F.col("identified_tasks.task_label"))
    single = F.col("task_label") if "task_label" in manifest.columns else F.lit(None).cast("string")
    labels = F.when(F.size("identified_tasks") > 0, labels).otherwise(F.coalesce(single, F.lit("Unknown")))
    rows = manifest.select(key.alias(KEY), F.coalesce("source_dataset", F.lit("Unknown")).alias("source_dataset"), labels.alias("task_labels"), "duration_sec", "fps")
    return rows.where(F.coalesce(F.col(KEY), F.lit("")) != "")


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def layer_rows(layer: DataFrame, name: str, corrected: bool = False) -> DataFrame:
    """One layer's columns, named <layer>_..., by walking its schema: aggregates flat, persons and tasks as JSON, summaries, other structs one level flat."""
    rows = layer.where(F.coalesce(F.col(KEY), F.lit("")) != "")
    out = [F.col(KEY)]
    for f in layer.schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if f.name in (KEY, "layer"):
            continue
        if f.name == "aggregate" and isinstance(kind, StructType):
            out += [c[x].alias(f"{name}_{x}") for x in kind.names]
        elif isinstance(kind, StructType):
            for x in kind.fields:
                nested = isinstance(x.dataType, StructType | ArrayType)
                out.append((_json(c[x.name]) if nested else c[x.name]).alias(f"{name}_{f.name}_{x.name}"))
        elif isinstance(kind, ArrayType):
            out.append(_json(c).alias(f"{name}_{f.name}_raw"))
        else:
            out.append(c.alias(f"{name}_{f.name}"))
    flat = rows.select(*out)
    if "tasks_analyzed" in layer.columns:
        sums = summarise(rows, name, KEY, corrected)
        sums = sums.select(KEY, *(F.col(c).alias(f"{name}_{c}") for c in sums.columns if c != KEY))
        flat = flat.join(sums, KEY, "left")
    return flat


def wide_rows(manifest: DataFrame, layers: dict[str, DataFrame], corrected: bool = False) -> DataFrame:
    """Every id of the manifest or of any layer gets a row; what a source lacks is null. Empty layers (no columns) add nothing."""
    tables = [base_rows(manifest), *(layer_rows(df, name, corrected) for name, df in layers.items() if KEY in df.columns)]
    return outer_fold(tables, KEY)
