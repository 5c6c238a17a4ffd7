"""Filtering and peaks of long series against plain loops."""

import time

import numpy as np
import pytest

from reverie.operators import series as S


def plain_filter(b, a, v, state):
    out = np.empty_like(v)
    for i, value in enumerate(v):
        out[i] = b[0] * value + state[0]
        state = np.append(state[1:], 0.0) + b[1:] * value - a[1:] * out[i]
    return out


def plain_zero_phase(b, a, x):
    n = 3 * max(len(a), len(b))
    companion = np.vstack([-a[1:], np.eye(len(a) - 2, len(a) - 1)]).T
    steady = np.linalg.solve(np.eye(len(a) - 1) - companion, b[1:] - a[1:] * b[0])
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    y = plain_filter(b, a, y, steady * y[0])[::-1]
    return plain_filter(b, a, y, steady * y[0])[::-1][n:-n]


def plain_peaks(x, least):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            left, right = np.flatnonzero(x[:i] > x[i]), np.flatnonzero(x[j + 1 :] > x[i])
            base = max(x[(left[-1] if len(left) else 0) : i].min(), x[j + 1 : (j + 1 + right[0] if len(right) else len(x))].min())
            if x[i] - base >= least:
                out.append((i + j) // 2)
        i = j + 1
    return out


@pytest.mark.parametrize("n", [16, 17, 100, 5000])
def test_zero_phase_equals_the_loop(n):
    x = np.cumsum(np.random.default_rng(n).normal(size=n))
    for low, high in ((0.25, 0.75), (0.125, 0.375), (0.0625, 0.1875), (0.02, 0.99)):
        b, a = S.band_pass(low, high)
        assert np.abs(S.zero_phase(b, a, x) - plain_zero_phase(b, a, x)).max() < 1e-9 * max(1, np.abs(x).max())
    with pytest.raises(ValueError):
        S.zero_phase(*S.band_pass(0.1, 0.3), x[:15])


def test_zero_phase_of_a_series_in_blocks(spark):
    rng = np.random.default_rng(1)
    long = {("v", 1): np.cumsum(rng.normal(size=5321)), ("v", 2): rng.normal(size=1000), ("w", 1): rng.normal(size=16), ("w", 2): rng.normal(size=15)}
    rows = [(v, p, i / 16, float(x), f"r{i}") for (v, p), xs in long.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "video_id string, person int, t double, angle double, note string").repartition(5)
    b, a = S.band_pass(0.125, 0.375)
    got = {}
    for r in S.zero_phase_series(df, ["video_id", "person"], "t", "angle", b, a, block_rows=1000).collect():
        assert r["note"] == f"r{round(r['t'] * 16)}"
        got.setdefault((r["video_id"], r["person"]), {})[r["t"]] = r["angle"]
    assert set(got) == {k for k, x in long.items() if len(x) > 15}
    for k, by_t in got.items():
        assert np.abs(np.array([by_t[t] for t in sorted(by_t)]) - plain_zero_phase(b, a, long[k])).max() < 1e-9


def test_peaks_equal_the_loop():
    rng = np.random.default_rng(3)
    for k in range(300):
        x = rng.integers(0, rng.integers(2, 12), rng.integers(0, 60)).astype(float)
        for least in (0.5, 1, 3):
            assert S.prominent_peaks(x, least) == plain_peaks(x, least)
    walk = np.round(np.cumsum(rng.normal(size=3000)), 1)
    assert S.prominent_peaks(walk, 0.5) == plain_peaks(walk, 0.5)


def test_a_day_of_samples_takes_seconds():
    x = np.cumsum(np.random.default_rng(4).normal(size=1_400_000))
    began = time.monotonic()
    S.prominent_peaks(x, 0.03)
    S.zero_phase(*S.band_pass(0.125, 0.375), x)
    assert time.monotonic() - began < 20


def test_oscillation_of_known_movements():
    """Checked-in expectations: (Hz, confidence) of plain loops over these signals."""
    t = np.arange(64) / 16
    nod = 0.1 * np.sin(2 * np.pi * 2 * t)
    hz, sure = S.oscillation(nod, 16.0)
    assert hz == pytest.approx(2.0, abs=0.2) and sure == 1.0
    assert S.oscillation(np.zeros(64), 16.0) == (0.0, 0.0)
    slow = S.oscillation(0.1 * np.sin(2 * np.pi * 0.3 * t), 16.0)
    assert slow[1] == 0.0
    x = plain_zero_phase(*S.band_pass(0.125, 0.375), nod - nod.mean())
    extrema = len(plain_peaks(x, 0.03)) + len(plain_peaks(-x, 0.03))
    assert hz == extrema / 2 / 4 and sure == min(1.0, 0.5 + 0.1 * extrema) * min(1.0, np.sqrt((x**2).mean()) / 0.05)


def test_blocks_are_filtered_side_by_side(spark):
    b, a = S.band_pass(0.125, 0.375)
    rng = np.random.default_rng(8)
    xs = [rng.normal(size=n) for n in (1, 32, 32, 7, 32, 900, 32, 32, 32, 32, 7, 7, 7)]
    begun = rng.normal(size=(len(xs), 4))
    out, left = S.filtered_all(b, a, xs, begun)
    for x, s, y, e in zip(xs, begun, out, left):
        want = S.filtered(b, a, x, s)
        assert np.abs(y - want[0]).max() < 1e-12 and np.abs(e - want[1]).max() < 1e-12
    df = spark.createDataFrame([(k, i, float(x)) for k in range(40) for i, x in enumerate(rng.normal(size=20 + k))], "k int, i int, x double")
    filtered = S.zero_phase_series(df, ["k"], "i", "x", b, a, block_rows=32)
    assert "FlatMapGroupsInPandas" not in filtered._jdf.queryExecution().executedPlan().toString()  # many short series are no Python call each
    assert filtered.count() == df.count()


def test_traces_of_many_persons_share_a_batch(spark):
    rng = np.random.default_rng(9)
    sizes = [*rng.integers(1, 40, 300).tolist(), 25_000, 3]  # one is longer than two batches of Arrow
    rows = [(None if k == 7 else f"v{k % 5}", k, i / 8, float("nan") if x > 2 else float(x) / 10, None if x < -2 else float(y)) for k, n in enumerate(sizes) for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "v string, k int, t double, p double, y double").repartition(5)
    for least in (1, 5):
        found = S.oscillations(df, ["v", "k"], "t", "p", "y", least)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # no Python call for each person
        got = {r["k"]: r for r in found.collect()}
        assert sorted(got) == [k for k, n in enumerate(sizes) if n >= least]
        for k, n in enumerate(sizes):
            if n < least:
                continue
            own = [r for r in rows if r[1] == k]
            x = [np.array([np.nan if r[c] is None else r[c] for r in own]) for c in (3, 4)]
            filled = [S.filled_by_index(v) for v in x]
            r = got[k]
            assert r["n"] == n and r["v"] == own[0][0] and r["interpolated"] == (max(s for _, s in filled) if n >= 5 else None)
            if n > 16:  # spaced evenly by eighths, so n samples again or one less
                grid = np.linspace(0, (n - 1) / 8, max(5, int((n - 1) / 8 * (1 / np.diff(np.arange(n) / 8).mean()))))
                want = [S.oscillation(np.interp(grid, np.arange(n) / 8, v), (len(grid) - 1) / ((n - 1) / 8)) for v, _ in filled]
                assert (r["pitch_hz"], r["pitch_conf"]) == want[0] and (r["yaw_hz"], r["yaw_conf"]) == want[1]
