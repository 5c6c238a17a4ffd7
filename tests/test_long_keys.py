"""Keys of very many rows: percentiles by selection, and values carried from range to range."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.operators import aggregates as A
from reverie.operators import joins as J
from reverie.operators.ranks import carried


def plain(values, share):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    at = share * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi


@pytest.mark.parametrize("few, bins, hot", [(60, 64, 1_000), (250, 256, 1)])
def test_percentiles_by_selection(spark, monkeypatch, few, bins, hot):
    monkeypatch.setattr(A, "_HOT_KEYS", hot)
    rng = np.random.default_rng(2)
    keys = {"walk": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000), "one": np.full(700, 7.5), "wide": 10.0 ** rng.integers(-200, 200, 900), "few": [1.0, 2.0], "single": [3.0], None: rng.normal(size=400), "jump": [0.0] * 500 + [1e300] * 501, "edge": [-math.inf] * 30 + [math.inf] * 31 + [0.0] * 9}
    rows = [(k, 1, float(x)) for k, xs in keys.items() for x in xs] + [("none", 1, None), ("walk", 1, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["a"]: r[2:] for r in A.percentiles(df, ["a", "b"], "x", shares, [f"p{i}" for i in range(5)], few=few, bins=bins).collect()}
    assert set(got) == {*keys, "none"} and got["none"] == (None,) * 5
    for k, xs in keys.items():
        want = [plain(map(float, xs), s) for s in shares]
        assert all(g == pytest.approx(w, rel=1e-12) or (math.isnan(g) and math.isnan(w)) for g, w in zip(got[k], want)), k
    assert A.percentiles(df.limit(0), ["a"], "x", [0.5], ["m"]).count() == 0


def test_masked_median_of_a_long_key(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(501)] + [("b", i, 0) for i in range(9)] + [("c", 5, 1)], "k string, d int, m int")
    got = {r["k"]: r["median"] * 255 for r in A.masked_median(df, ["k"], "d", F.col("m") == 1).collect()}
    assert got == pytest.approx({"a": 250.0, "b": 4.0, "c": 5.0})


def test_carried_over_ranges(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, None, None, i])) for k, n in (("hot", 4000), ("a", 3), ("b", 1), (None, 50)) for i in range(n)] + [("bare", i, None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(7)
    got = {(r["k"], r["t"]): (r["was"], r["next"]) for r in carried(df, ["k"], [F.col("t")], "v", "was", "next").collect()}
    by_key = {}
    for k, t, v in rows:
        by_key.setdefault(k, []).append((t, v))
    for k, series in by_key.items():
        known = [v for _, v in sorted(series) if v is not None]
        for t, v in series:
            assert got[k, t] == (max((x for x in known if x <= t), default=None), min((x for x in known if x >= t), default=None))
    assert len(got) == len(rows)


@pytest.mark.parametrize("tolerance", [None, 3.0])
def test_nearest_on_a_hot_key(spark, tolerance):
    rng = random.Random(6)
    left = [(i, k, rng.randrange(4000) / 4) for k, n in (("hot", 3000), ("cold", 20), ("alone", 5)) for i in range(n)]
    right = [(k, rng.randrange(4000) / 4, i) for k, n in (("hot", 900), ("cold", 3), ("unmet", 4)) for i in range(n)]
    l, r = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, u double, n int")
    got = {(x["k"], x["id"]): x["n"] for x in J.nearest_join(l, r, ["k"], "t", "u", ["u", "n"], tolerance, ["id", "k"]).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        near = min(((abs(u - t), u, n) for kk, u, n in right if kk == k and (tolerance is None or abs(u - t) <= tolerance)), default=(None,) * 3)
        assert got[k, i] == near[2]
