"""Model tiers: the dimension table and its lookups."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("small", "medium", "large")
MEDIUM_FROM = 48 * 1024**3


def active_tier(host_bytes: int, override: str | None = None) -> str:
    """The override if it is a tier, else medium from 48 GiB on and small below."""
    wanted = override if override is not None else os.environ.get("REVERIE_TIER")
    if wanted in TIERS:
        return wanted
    if wanted:
        warnings.warn(f"unknown tier {wanted!r}")
    return "medium" if host_bytes >= MEDIUM_FROM else "small"


def models_table(spark: SparkSession, rows: list[tuple[str, str, str, int | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "layer_key string, tier string, model_id string, bytes long")


def model_for(models: DataFrame, layer_key: str, tier: str) -> str:
    row = models.where((F.col("layer_key") == layer_key) & (F.col("tier") == tier)).first()
    if row is None:
        raise KeyError(f"no model for {layer_key!r} at tier {tier!r}")
    return row["model_id"]


def with_installed_tag(models: DataFrame, installed: DataFrame) -> DataFrame:
    """model_id, or <base>:latest where only that is installed."""
    have = installed.select(F.col("tag").alias("_t"))
    base = F.concat(F.substring_index("model_id", ":", 1), F.lit(":latest"))
    out = models.join(have, models["model_id"] == have["_t"], "left").withColumnRenamed("_t", "_own")
    out = out.join(have, base == have["_t"], "left")
    return out.select(*models.columns, F.when(F.col("_own").isNull() & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("model_id")).alias("resolved_id"))
