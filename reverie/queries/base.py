"""Registration of queries on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a person's series: t in seconds, a score from the value, the event type as the target."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", F.least(F.lit(1.0), F.col("value") / 50).alias("score"), "event_type"
    )


TRACE = "trace AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, least(1.0, value / 50) AS score, event_type FROM events)"


def rounded(x: str, digits: int) -> str:
    """The floor form of rounding, as SQL."""
    return f"(sign({x}) * floor(abs({x}) * 1e{digits} + 0.5) / 1e{digits})"
