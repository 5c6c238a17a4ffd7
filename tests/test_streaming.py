"""Samples that arrive in any order give what the batch gives, and state goes when persons do."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from reverie.operators.series import burst_sampled
from reverie.streaming import incremental

SCHEMA = "video_id string, person_id long, ts timestamp, score double"
START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    incremental.rocks(spark)
    yield
    spark.conf.unset(key)


def test_shuffled_arrival_equals_the_batch(spark, tmp_path, provider):
    rng = random.Random(7)
    grid = [("v", p, START + timedelta(microseconds=31250 * i), 0.9 if p and 16 <= i < 24 else 0.1) for p in (0, 1) for i in range(160)]
    batch = spark.createDataFrame(grid, SCHEMA).selectExpr("video_id", "person_id", "unix_micros(ts) / 1e6 AS t", "score")
    want = {(r["person_id"], r["t"], r["in_burst"]) for r in burst_sampled(batch, ["video_id", "person_id"], "t", "score").collect()}
    rows = sorted(grid, key=lambda r: r[2].timestamp() + rng.uniform(0, 1.5))  # late by up to a second and a half
    parts = [rows[i : i + 64] for i in range(0, len(rows), 64)] + [[("end", 9, START + timedelta(hours=1), 0.0)], [("end", 9, START + timedelta(hours=2), 0.0)]]
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"n={i}"))
        q = (
            incremental.late_burst_stream(spark.readStream.schema(SCHEMA).parquet(str(source / "*")), late="3 seconds")
            .writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = [(r["person_id"], r["t"], r["in_burst"]) for r in spark.read.parquet(str(tmp_path / "out")).where("video_id = 'v'").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for name in ("held", "walk"):
        state = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))
        assert state.where("key.video_id = 'v'").count() == 0
