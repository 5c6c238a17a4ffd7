"""Hand-computed vectors of the layers and their operators."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reverie.functions import maths as M
from reverie.functions import text as T
from reverie.operators import aggregates as A
from reverie.operators import filters as L
from reverie.operators import joins as J
from reverie.operators import series as S
from reverie.plans import layers
from reverie.plans.models import active_tier, model_for, models_table


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_area_delta(spark):
    rows = [("a", 1.0, 10000.0), ("a", 2.0, 40000.0), ("a", 3.0, 90000.0), ("b", 1.0, 90000.0), ("b", 2.0, 10000.0), ("c", 1.0, 5.0), ("d", 1.0, 0.0), ("d", 2.0, 9.0)]
    got = {r["k"]: r["area_delta_pct"] for r in A.area_delta(spark.createDataFrame(rows, "k string, t double, area double"), ["k"], "t", F.col("area")).collect()}
    assert got["a"] == 800.0 and round(got["b"], 2) == -88.89 and got["c"] is None and got["d"] == 0.0


@pytest.mark.parametrize("area,depth,vector,action", [(25, -0.3, 0.56, "Approach_Intervention"), (-25, 0.2, -0.44, "Avoidance"), (10, -0.05, 0.14, "Neutral"), (1, 0.0, 0.0, "Neutral")])
def test_proxemic_vector(spark, area, depth, vector, action):
    v = M.proxemic_vector(F.lit(float(area)), F.lit(depth))
    row = one(spark, v=v, a=M.proxemic_action(v), low=M.proxemic_action(v, 0.1), c=M.proxemic_confidence(F.lit(float(area)), F.lit(depth)))
    assert row["v"] == vector and row["a"] == action
    assert row["low"] == ("Approach_Intervention" if vector > 0.1 else "Avoidance" if vector < -0.1 else "Neutral")


def test_slope_span(spark):
    rows = [("a", t, d) for t, d in zip((1.0, 1.5, 2.0, 2.5, 3.0), (0.5, 0.3, 0.3, 0.3, 0.0))] + [("b", 1.0 + i * 0.5, 0.5 - i * 0.05) for i in range(5)] + [("c", 1.0, 1.0)]
    got = {r["k"]: r["delta"] for r in A.slope_span(spark.createDataFrame(rows, "k string, t double, d double"), ["k"], "t", "d").collect()}
    assert math.isclose(got["a"], -0.4, abs_tol=1e-9) and math.isclose(got["b"], -0.2, abs_tol=1e-9) and got["c"] is None


@pytest.mark.parametrize(
    "scores,db,var,tone,scalar",
    [({"angry": 0.6, "fearful": 0.3}, -10.0, 0.0, "Alarming", -1.0), ({"happy": 0.5, "surprised": 0.3}, -25.0, 0.9, "Soothing", 1.0), ({"sad": 0.7}, -40.0, 0.0, "Discouraging", -0.5), ({"neutral": 0.7}, -25.0, 0.0, "Neutral", 0.0), ({"angry": 0.1}, -25.0, 0.0, "Neutral", 0.0)],
)
def test_tone(spark, scores, db, var, tone, scalar):
    m = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    row = one(spark, t=M.tone(m, F.lit(db), F.lit(var)))["t"]
    assert (row["tone"], row["scalar"]) == (tone, scalar)


def test_emotion_slices_and_score(spark):
    rows = [("v", "t", 1, 6.2, "neutral", 1.0), ("v", "t", 1, 6.7, "anger", 1.0), ("v", "t", 1, 7.7, "anger", 0.0), ("v", "t", 1, 8.2, "happiness", 1.0), ("v", "t", 2, 7.0, "joy", 1.0)]
    samples = spark.createDataFrame(rows, "video_id string, task_id string, person_id long, t double, emotion string, magnitude double")
    tasks = spark.createDataFrame([("v", "t", 6.2, 6.2, 8.2)], "video_id string, task_id string, climax_sec double, win_start double, win_end double")
    slices, persons, scores = layers.emotion(samples, tasks)
    got = [(r["slice_start"], r["slice_end"], r["direction"]) for r in slices.orderBy("person_id", "slice_id").collect()]
    assert got == [(6.2, 7.7, "negative"), (7.7, 8.2, "positive")]
    assert [(r["person_id"], r["late_stage_score"]) for r in persons.collect()] == [(1, 0.83)]
    assert scores.first()["task_aggregate_score"] == 0.83
    lines = S.history(slices, ["video_id", "task_id", "person_id"]).orderBy("slice_id").collect()[-1]["history"]
    assert lines == "1. neutral -> anger (Classified: negative)\n2. anger -> joy (Classified: positive)"


def test_attention_of_a_centred_box(spark):
    gaze = spark.createDataFrame([("v", 1, t, 0.0, 0.0) for t in (0.0, 0.5, 1.0)], "video_id string, person_id long, t double, pitch_rad double, yaw_rad double")
    boxes = spark.createDataFrame([("v", 1, t, 10, 10, 50, 50) for t in (0.0, 0.5, 1.0)], "video_id string, person_id long, t double, x1 int, y1 int, x2 int, y2 int")
    camera = spark.createDataFrame([("v", 100, 100)], "video_id string, width int, height int").selectExpr("*", "cast(null as double) cx", "cast(null as double) cy", "cast(null as double) focal")
    trace = layers.attention(gaze, boxes, camera).withColumn("target", F.lit("person"))
    assert {r["score"] for r in trace.collect()} == {0.92}
    row = layers.attention_summary(trace).first()
    assert row["average_attention_score"] == 0.92 and row["peak_engagement_timestamp_sec"] == 0.0 and row["sustained_engagement_sec"] == 1.0 and row["is_engaged"] and row["attention_variance"] == 0.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.booleans()), min_size=1, max_size=60, unique_by=lambda x: (x[0], x[1])))
def test_sustained_equals_a_scan(spark, rows):
    got = {r["k"]: r["sustained"] for r in S.sustained(spark.createDataFrame(rows, "k int, t int, on boolean").withColumn("t", F.col("t").cast("double")), ["k"], "t", F.col("on")).collect()}
    for k in {r[0] for r in rows}:
        best, start = 0.0, None
        for _, t, on in sorted(r for r in rows if r[0] == k):
            start = (t if start is None else start) if on else None
            best = max(best, t - start if on else 0.0)
        assert got[k] == best


@pytest.mark.parametrize("tolerance", [2.0, None])
def test_nearest_join_equals_brute_force(spark, tolerance):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.randrange(100) / 2) for i in range(120)] + [(500, 9, 1.0)]
    right = [(rng.randrange(3), rng.randrange(100) / 2, j) for j in range(60)]
    got = J.nearest_join(spark.createDataFrame(left, "id long, k int, t double"), spark.createDataFrame(right, "k int, u double, j long"), ["k"], "t", "u", ["j"], tolerance, ["id"]).collect()
    assert len(got) == len(left)
    for r in got:
        near = sorted((abs(u - r["t"]), j) for k, u, j in right if k == r["k"] and (tolerance is None or abs(u - r["t"]) <= tolerance))
        assert r["j"] == (near[0][1] if near else None)


def test_spikes_and_responses(spark):
    flow = spark.createDataFrame([("v", t, v) for t, v in ((1.0, 20.0), (1.2, 15.0), (2.0, 5.0))] + [("w", 1.0, 2.0)], "k string, t double, v double")
    spikes = S.spikes(flow, ["k"], "v").select("k", "t")
    assert sorted(r["t"] for r in spikes.collect()) == [1.0, 1.2]
    peaks = spark.createDataFrame([("v", 1.5), ("v", 1.0)], "k string, p double")
    row = J.spike_response(spikes, peaks, ["k"], "t", "p").first()
    assert row["detected"] and round(row["delay"], 6) == 0.3


def test_centring(spark):
    def centred(t, box):
        df = spark.createDataFrame([("v", t, *map(float, box))], "k string, t double, x1 double, y1 double, x2 double, y2 double").withColumns({"s": F.lit(0.0), "e": F.lit(1.0)})
        return S.tail_centred(df, ["k"], "t", "s", "e", (F.col("x1") + F.col("x2")) / 960, (F.col("y1") + F.col("y2")) / 960).first()["centred"]

    assert centred(0.9, (200, 200, 280, 280)) and not centred(0.5, (200, 200, 280, 280)) and not centred(2.5, (200, 200, 280, 280)) and not centred(0.9, (10, 10, 50, 50))


def test_summaries_of_the_registry(spark):
    person = "struct<person_id:bigint,proxemic_vector:double,proxemic_confidence:double,classified_action:string>"
    rows = [("v", [("t0", [(1, 0.5, 0.2, "Neutral"), (2, -0.5, 0.9, "Approach_Intervention")]), ("t1", [(1, -0.25, None, None)])]), ("w", [])]
    df = spark.createDataFrame(rows, f"video_id string, tasks_analyzed array<struct<task_id:string,per_person:array<{person}>>>")
    row = A.summarise(df, "03d_proxemic_kinematics").first()
    assert row["max_abs_proxemic_vector"] == 0.5 and row["max_proxemic_confidence"] == 0.9 and row["any_approach_detected"] is False
    assert A.summarise(df, "03d_proxemic_kinematics", corrected=True).first()["any_approach_detected"] is True
    tasks = spark.createDataFrame([("v", [("t0", 0.75), ("t1", 0.5)])], "video_id string, tasks_analyzed array<struct<task_id:string,task_aggregate_score:double>>")
    assert A.summarise(tasks, "03b_reasonable_emotion").first()["avg_task_score"] == 0.625
    with pytest.raises(ValueError):
        A.summary("x", "median", "y", F.col("x"), "double", F.lit(0))


def test_text_rules(spark):
    row = one(
        spark,
        fast=T.velocity_class(F.lit("Make Breakfast")), slow=T.velocity_class(F.lit("Reading")), medium=T.velocity_class(F.lit("Stirring")), events=T.audio_events(F.lit("a <|sneeze|> cough <|laughter|>")),
        yes=T.says_yes(F.lit("  yes, two")), choice=T.first_choice(F.lit("frame 2 of 9")), none=T.first_choice(F.lit("no")), fold=T.folded_emotion(F.lit("Contempt")), leak=T.leaks(F.lit("/Users/x")), clean=T.leaks(F.lit("see /Users/x")),
        tail=T.after_slash(F.lit("生气/angry")), stem=T.stem(F.lit("file:/a/b.c/x.y.mp4")), labels=T.joined_labels(F.array(F.lit("a"), F.lit(None))), bytes=T.human_bytes(F.lit(2_500_000_000)),
        solo=L.likely_solo(F.array(F.lit("Reading  Books"), F.lit("sleeping"))), mixed=L.likely_solo(F.array(F.lit("sleeping"), F.lit("cooking"))), empty=L.likely_solo(F.array().cast("array<string>")),
        valid=L.valid_tasks(F.array(F.lit(" Idling"), F.lit(" Cook "), F.lit(""))),
    )
    assert (row["fast"], row["slow"], row["medium"], row["events"]) == ("fast", "slow", "medium", ["laughter", "sneeze"])
    assert row["yes"] and row["choice"] == 2 and row["none"] is None and row["fold"] == "disgust" and row["leak"] and not row["clean"]
    assert row["tail"] == "angry" and row["stem"] == "x.y" and row["labels"] == "a, Unknown" and row["bytes"] == "2.5 GB"
    assert row["solo"] and not row["mixed"] and not row["empty"] and row["valid"] == ["Cook"]


def test_reaction_windows_are_clamped(spark):
    a, b = M.reaction_window(F.lit(6.2), F.lit("slow"), F.lit(9.004))
    row = one(spark, a=a, b=b)
    assert (row["a"], row["b"]) == (8.2, 9.0)


def test_band_pass_and_zero_phase():
    b, a = S.band_pass(0.25, 0.75)
    w = np.exp(-1j * np.pi * np.linspace(0, 1, 101))
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert gain[0] < 1e-9 and gain[100] < 1e-9 and abs(gain[50] - 1) < 1e-6 and np.allclose(gain[[25, 75]], 1 / np.sqrt(2), atol=1e-6)
    x = np.random.default_rng(0).normal(size=200)
    assert np.allclose(S.zero_phase(b, a, x)[60:140], S.zero_phase(b, a, x[::-1])[::-1][60:140], atol=1e-3)
    assert abs(S.zero_phase(b, a, np.ones(50))).max() < 1e-6
    with pytest.raises(ValueError):
        S.zero_phase(b, a, np.ones(15))


def test_oscillation_of_a_nod():
    t = np.linspace(0, 5, 60)
    hz, conf = S.oscillation(0.1 * np.sin(2 * np.pi * 2 * t) + np.random.default_rng(2).normal(0, 0.01, 60), 12)
    assert abs(hz - 2) < 0.4 and conf > 0.5
    assert S.oscillation(np.zeros(60), 12) == (0.0, 0.0)


def test_oscillations_with_gaps(spark):
    t = np.linspace(0, 5, 60)
    pitch = 0.1 * np.sin(2 * np.pi * 2 * t)
    pitch[5:10] = np.nan
    rows = [("a", float(x), float(p), 0.0) for x, p in zip(t, pitch)] + [("b", float(x), 0.1, 0.0) for x in t[:4]]
    got = {r["k"]: r for r in S.oscillations(spark.createDataFrame(rows, "k string, t double, p double, y double"), ["k"], "t", "p", "y").collect()}
    assert got["a"]["pitch_conf"] > 0.5 and math.isclose(got["a"]["interpolated"], 5 / 60) and got["b"]["pitch_conf"] is None


def test_nan_fill_matches_the_plan(spark):
    x = [math.nan, 1.0, math.nan, math.nan, 4.0, math.nan]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)] + [(1, 0, math.nan)], "k int, i int, v double")
    got = [r["v"] for r in S.nan_interpolated(df, ["k"], "i", "v").orderBy("k", "i").collect()]
    assert got == [*S.filled_by_index(np.array(x))[0].tolist(), 0.0] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0, 0.0]


def test_burst_sampling(spark):
    grid = [(0, i / 32, 0.9 if 1.0 <= i / 32 < 1.2 else 0.1) for i in range(32 * 5)]
    got = S.burst_sampled(spark.createDataFrame(grid, "k int, t double, s double"), ["k"], "t", "s").orderBy("t").collect()
    steps = Counter(round(b["t"] - a["t"], 4) for a, b in zip(got, got[1:]))
    assert set(steps) == {0.125, 0.0625} and steps[0.0625] > 30


def test_dominant_and_ties(spark):
    rows = [(1, 0.0, "b"), (1, 1.0, "a"), (1, 2.0, "a"), (1, 3.0, "b"), (2, 0.0, "Unknown")]
    got = {r["k"]: r["dominant"] for r in A.dominant(spark.createDataFrame(rows, "k int, t double, v string"), ["k"], "v", "t").collect()}
    assert got == {1: "b", 2: "Unknown"}


def test_tracks_round_trip(spark):
    rows = [("v", 1, t, 1, 2, 3, 4, 0.5) for t in (2.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "video_id string, person_id long, t double, x1 int, y1 int, x2 int, y2 int, conf double")
    tracks = A.tracks(df, ["video_id", "person_id"], "t", ["x1", "y1", "x2", "y2"], "conf")
    assert tracks.first()["timestamps_sec"] == [0.5, 1.0, 2.0]
    assert sorted(r["t"] for r in A.exploded_tracks(tracks, ["video_id", "person_id"]).collect()) == [0.5, 1.0, 2.0]


def test_velocities(spark):
    rows = [("v", 0.0, 1, 0.0, 0.0), ("v", 0.0, 2, 0.0, 0.0), ("v", 0.5, 1, 0.3, 0.4), ("v", 2.0, 1, 9.0, 9.0)]
    got = S.velocities(spark.createDataFrame(rows, "k string, t double, p int, x double, y double"), ["k"], "t", "p", "x", "y").collect()
    assert [(r["t"], r["velocity"]) for r in got] == [(0.5, 1.0)]


def test_layer_plans_end_to_end(spark):
    tasks = spark.createDataFrame([("v", "t_00", 1.0, 3.0)], "video_id string, task_id string, win_start double, win_end double")
    boxes = spark.createDataFrame([("v", 1, 1.0 + 0.5 * i, 0.0, 0.0, 100.0 + 20 * i, 100.0 + 20 * i) for i in range(5)], "video_id string, person_id long, t double, x1 double, y1 double, x2 double, y2 double")
    depth = spark.createDataFrame([("v", "t_00", 1, 1.0 + 0.5 * i, 0.5 - 0.1 * i) for i in range(5)], "video_id string, task_id string, person_id long, t double, depth double")
    quiet = spark.createDataFrame([("v", "t_00", 1.0)], "video_id string, task_id string, noise double")
    row = layers.proxemics(boxes, depth, quiet, tasks).first()
    assert round(row["area_delta_pct"], 6) == 224.0 and row["classified_action"] == "Approach_Intervention" and row["proxemic_confidence"] == 1.0
    row = layers.proxemics(boxes, depth, quiet.withColumn("noise", F.lit(20.0)), tasks).first()
    assert (row["proxemic_vector"], row["proxemic_confidence"], row["classified_action"], row["depth_delta"]) == (0.0, 0.0, "Neutral", 0.0)
    flow = spark.createDataFrame([("v", "t_00", t, m, m, dx, dy) for t, m, dx, dy in ((1.0, 20.0, -9.0, -2.0), (1.5, 2.0, -9.0, 0.0), (2.5, 1.0, -9.0, 0.0))], "video_id string, task_id string, t double, mean_mag double, p95_mag double, mean_dx double, mean_dy double")
    points = spark.createDataFrame([("v", "t_00", 1, t, 1, x, 0.0) for t, x in ((0.9, 0.0), (1.2, 0.9))], "video_id string, task_id string, person_id long, t double, kpt int, x double, y double")
    angles = spark.createDataFrame([("v", "t_00", 1, t, a) for t, a in ((0.8, 0.0), (1.3, 0.25))], "video_id string, task_id string, person_id long, t_angle double, angle double")
    row = layers.resonance(flow, points, angles).first()
    spine = points.union(spark.createDataFrame([("v", "t_00", 1, t, k, x, y) for t, k, x, y in ((0.8, 5, 1.0, 0.0), (0.8, 12, 0.0, 0.0), (1.3, 6, 1.0, math.tan(0.25)), (1.3, 11, 0.0, 0.0), (1.3, 3, 5.0, 5.0))], points.schema))
    assert abs(layers.resonance(flow, spine).first()["mirroring_scalar"] - 0.5) < 1e-9
    assert row["motor_resonance_detected"] and round(row["resonance_delay_sec"], 6) == 0.2 and row["mirroring_detected"] and row["mirroring_scalar"] == 0.5 and row["ego_kinetic_chaos_score"] == 1.0
    videos = spark.createDataFrame([("v", 300, 300)], "video_id string, width int, height int")
    row = layers.shared_reality(flow, boxes, tasks, videos).first()
    assert row["shift_x"] == 27.0 and row["bystander_centered_in_fov"] is False and row["social_reference_sought"] is False
    audio = spark.createDataFrame([("v", "t_00", -10.0, 0.0, {"angry": 0.5, "fearful": 0.3}, "<|cough|>"), ("v", "t_01", None, None, None, None)], "video_id string, task_id string, max_dbfs double, pitch_var double, scores map<string,double>, sv_text string")
    got = {r["task_id"]: r for r in layers.prosody(audio).collect()}
    assert got["t_00"]["classified_acoustic_tone"] == "Alarming" and got["t_00"]["audio_events"] == ["cough"] and got["t_00"]["dominant_emotion"] == "angry"
    assert got["t_01"]["classified_acoustic_tone"] == "Neutral" and got["t_01"]["max_dbfs"] == -100.0 and got["t_01"]["dominant_emotion"] == "neutral"
    t = np.linspace(1, 3, 40)
    trace = spark.createDataFrame([("v", 1, float(x), float(0.1 * np.sin(4 * np.pi * x)), 0.0) for x in t], "video_id string, person_id long, t double, pitch_rad double, yaw_rad double")
    row = layers.gesture(trace, tasks, F.lit("none")).first()
    assert row["gesture_detected"] == "affirming_nod" and row["interpolated_fraction"] == 0.0
    row = layers.gesture(trace.withColumn("yaw_rad", F.col("pitch_rad")), tasks, F.lit("none")).first()
    assert row["gesture_detected"] == "ambiguous_wobble"
    for missing in (None, trace.limit(0)):
        with pytest.raises(RuntimeError, match="missing or empty"):
            layers.gesture(missing, tasks, F.lit("none"))
    full = spark.createDataFrame([("v", 10.0, ["Cook", " idling ", "Slip"])], "video_id string, duration_sec double, labels array<string>")
    tiled = layers.tasks_of(full, "labels")
    motion = spark.createDataFrame([("v", i / 4, 1.0 if i == 26 else 0.1) for i in range(40)], "video_id string, t double, mean_mag double")
    got = {r["task_id"]: r for r in layers.with_climax(tiled, motion).collect()}
    assert (got["t_01"]["task_velocity"], got["t_01"]["climax_sec"], got["t_01"]["win_start"], got["t_01"]["win_end"]) == ("fast", 6.5, 7.0, 8.5)


def test_model_tiers(spark):
    m = models_table(spark, [("a", "small", "x:1", 5), ("a", "medium", "y:1", None)])
    assert active_tier(1, "large") == "large" and active_tier(64 << 30, "") == "medium" and active_tier(1, None) == "small"
    assert model_for(m, "a", "medium") == "y:1" and A.resident_bytes(m, "small").first()["bytes"] == 5
    with pytest.raises(KeyError):
        model_for(m, "b", "small")


@pytest.mark.parametrize("nod,shake,label,sure", [(0.6, 0.6, "none", 0.0), (0.7, 0.84, "ambiguous_wobble", 0.77), (0.7, 0.9, "negating_shake", 0.9), (0.9, 0.7, "affirming_nod", 0.9), (0.61, 0.2, "affirming_nod", 0.61)])
def test_gesture_decision(spark, nod, shake, label, sure):
    row = one(spark, g=M.gesture(F.lit(nod), F.lit(shake)))["g"]
    assert row["label"] == label and round(row["confidence"], 9) == sure


def test_rounding_as_in_python(spark):
    rng = random.Random(1)
    values = [0.125, 0.375, 2.675, 1.005, -0.125, 0.5, 1.5, -2.5, 1e-9, 0.0] + [rng.randint(-4000, 4000) / 1000 for _ in range(500)] + [rng.uniform(-5, 5) for _ in range(500)]
    for digits in (0, 2, 4):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.py_round(F.col("v"), digits).alias("p"), M.r(F.col("v"), digits).alias("r")).collect()
        assert [r["p"] + 0.0 for r in rows] == [round(r["v"], digits) + 0.0 for r in rows]


def test_interval_join_meets_no_far_pair(spark):
    points = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"))
    windows = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 10.0).alias("s"), (F.col("id") * 10.0 + F.when(F.col("id") == 3, 1900.0).otherwise(4.0)).alias("e"))
    got = J.interval_join(points, windows, ["k"], "t", "s", "e")
    brute = [(t, w) for t in range(2000) for w in range(200) if w * 10 <= t <= w * 10 + (1900 if w == 3 else 4)]
    assert got.count() == len(brute)
    width = 13.5  # the mean length, so each window stands in two buckets on average
    reach = windows.select(F.sum(F.floor(F.col("e") / width) - F.floor(F.col("s") / width) + 1)).first()[0]
    assert reach <= 3 * 200
    assert J.interval_join(points, windows.limit(0), ["k"], "t", "s", "e").count() == 0


def test_gaze_at_hands(spark):
    gaze = spark.createDataFrame([("v", 1, t, 0.0, 0.0) for t in (0.0, 1.0, 5.0)], "video_id string, person_id int, t double, pitch_rad double, yaw_rad double")
    boxes = spark.createDataFrame([("v", 1, t, 80.0, 80.0, 100.0, 100.0) for t in (0.0, 5.0)], "video_id string, person_id int, t double, x1 double, y1 double, x2 double, y2 double")
    camera = spark.createDataFrame([("v", 100, 100, None, None, None)], "video_id string, width int, height int, cx double, cy double, focal double")
    hands = spark.createDataFrame([("v", 0.2, [[45.0, 45.0, 55.0, 55.0], [0.0, 0.0, 4.0, 4.0]]), ("v", 5.1, [])], "video_id string, t double, hand_boxes array<array<double>>")
    rows = {r["t"]: r for r in layers.attention(gaze, boxes, camera, hands=hands).collect()}
    assert rows[0.0]["target"] == rows[1.0]["target"] == "POV_Actor_Hands" and rows[0.0]["score"] == 1.0
    assert rows[5.0]["target"] == "Camera" and rows[5.0]["score"] < 1.0


def test_pose_pick_falls_back(spark):
    rows = [("one", 0, None, None), ("box", 0, 0.2, 9.0), ("box", 1, 0.5, 1.0), ("box", 2, 0.5, 2.0), ("spread", 0, 0.9, 1.0), ("spread", 1, None, 3.0), ("none", 0, None, None), ("none", 1, None, None)]
    d = spark.createDataFrame(rows, "k string, i int, iou double, spread double")
    assert {r["k"]: r["i"] for r in L.pose_pick(d, ["k"], "i", "iou", "spread").collect()} == {"one": 0, "box": 1, "spread": 1, "none": 0}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_samples_of_a_task_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = spark.createDataFrame([("v", "a", 1, 0.5 * i, 5, 1.0 * i, 0.0) for i in range(4)], "video_id string, task_id string, person_id int, t double, kpt int, x double, y double")
        tasks = spark.createDataFrame([("v", "a", 0.5, 1.5)], "video_id string, task_id string, win_start double, win_end double")
        keys = ["video_id", "task_id", "person_id"]
        moves = S.velocities(layers.within(samples, tasks, layers.TASK), keys, "t", "kpt", "x", "y")
        assert _shuffles(moves) == 2  # samples and windows, by task; neither the join of successive samples nor the means shuffle again
        assert sorted((r["t"], r["velocity"]) for r in moves.collect()) == [(1.0, 2.0), (1.5, 2.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_velocities_of_repeated_and_unknown_points(spark):
    rows = [("v", 0.0, 1, 0.0, 0.0), ("v", 0.0, 1, 0.0, 1.0), ("v", 0.5, 1, 0.0, 3.0), ("v", 0.5, None, 0.0, 9.0), ("v", 1.0, 1, None, 0.0), (None, 0.0, 1, 0.0, 0.0), (None, 0.5, 1, 0.0, 1.0)]
    got = S.velocities(spark.createDataFrame(rows, "k string, t double, p int, x double, y double"), ["k"], "t", "p", "x", "y").collect()
    assert sorted((r["k"], r["t"], r["velocity"]) for r in got) == [("v", 0.5, 5.0), ("v", 1.0, None)]
