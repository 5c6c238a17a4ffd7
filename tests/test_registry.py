"""From a manifest and observation tables to records, reasons and the wide row."""

import json
import math

import pytest
from pyspark.sql import functions as F

from reverie.plans import layers, records, registry

MANIFEST = """video_id string, source_dataset string, duration_sec double, fps double, width int, height int, video_found boolean,
identified_tasks array<struct<task_id: string, task_label: string, task_temporal_metadata: struct<task_climax_sec: double, task_reaction_window_sec: array<double>>>>,
bystander_detections array<struct<person_id: int, timestamps_sec: array<double>, bounding_boxes: array<array<double>>>>"""
TIMES = [10 + i / 16 for i in range(64)]


def task(name, window=(10.0, 14.0)):
    return (name, "Cook", (9.5, list(window) if window else None))


def person(i, times=TIMES, grow=1.0):
    return (i, list(times), [[100.0, 100.0, 140.0 + grow * k, 140.0 + grow * k] for k in range(len(times))])


@pytest.fixture(scope="module")
def manifest(spark):
    every = [person(7), person(3)]
    rows = [
        ("full", "ego4d", 20.0, 30.0, 300, 300, True, [task("t_01"), task("t_00", None), task("t_02", (15.0, 16.0))], every),
        ("lost", "ego4d", 20.0, 30.0, 300, 300, False, [task("t_00")], every),
        ("idle", "ego4d", 20.0, 30.0, 300, 300, True, [], every),
        ("alone", "ego4d", 20.0, 30.0, 300, 300, True, [task("t_00")], []),
        ("still", "ego4d", 20.0, 30.0, 300, 300, True, [task("t_00")], every),
        ("faceless", "ego4d", 20.0, 30.0, 0, 300, True, [task("t_00")], every),
        ("open", "ego4d", 20.0, 30.0, 300, 300, True, [task("t_00", (1.0,))], [person(7, TIMES[:3])]),
        (None, "ego4d", 20.0, 30.0, 300, 300, True, [task("t_00")], every),
    ]
    return spark.createDataFrame(rows, MANIFEST)


@pytest.fixture(scope="module")
def tables(spark):
    wave = {t: 0.1 * math.sin(4 * math.pi * t) for t in TIMES}
    gaze = [(v, p, t, wave[t], 0.0) for v in ("full", "lost", "idle") for p in (7, 3) for t in TIMES] + [("still", 7, t, 0.0, 0.0) for t in TIMES[:4]]
    flow = [(v, k, 10 + i / 8, 8.0 if i == 4 else 1.0, 8.0 if i == 4 else 1.0, -9.0, -2.0) for v, k in (("full", "t_01"), ("faceless", "t_00")) for i in range(32)] + [("still", "t_00", 10.0 + i, 1.0, 1.0, 0.0, 0.0) for i in range(3)]
    depth = [("full", "t_01", p, 10 + i / 4, 0.5 - 0.02 * i * (p == 7)) for p in (7, 3) for i in range(16)]
    poses = [("full", "t_01", 7, t, 100.0, 100.0, 130.0, 140.0, 300, 300, body, k, 10.0 * k * (body + 1) + 5 * (t > 10.6), 3.0 + k, 0.9, *box) for t in (10.5, 10.7) for body, box in ((0, (0.0, 0.0, 5.0, 5.0)), (1, (0.0, 0.0, 29.0, 39.0))) for k in (3, 5, 6, 11)]
    columns = "video_id string, task_id string, person_id int, t double"
    return {
        "gaze": spark.createDataFrame(gaze, "video_id string, person_id int, t double, pitch_rad double, yaw_rad double"),
        "intrinsics": spark.createDataFrame([(v, 300, 300, None, None, None) for v in ("full", "lost", "idle", "still")], "video_id string, width int, height int, focal double, cx double, cy double"),
        "emotions": spark.createDataFrame([("full", "t_01", p, 10.5 + i, "joy" if i > 1 else "neutral", 0.8) for p in (7, 3) for i in range(4)], f"{columns}, emotion string, magnitude double"),
        "audio": spark.createDataFrame([("full", "t_01", -10.0, 0.0, {"angry": 0.5, "fearful": 0.3}, "<|cough|>")], "video_id string, task_id string, max_dbfs double, pitch_var double, scores map<string,double>, sv_text string"),
        "flow": spark.createDataFrame(flow, "video_id string, task_id string, t double, mean_mag double, p95_mag double, mean_dx double, mean_dy double"),
        "depth": spark.createDataFrame(depth, f"{columns}, depth double"),
        "noise": spark.createDataFrame([("full", "t_01", 1.25)], "video_id string, task_id string, noise double"),
        "poses": spark.createDataFrame(poses, f"{columns}, x1 double, y1 double, x2 double, y2 double, width int, height int, body int, kpt int, x double, y double, conf double, bx1 double, by1 double, bx2 double, by2 double"),
    }


def test_manifest_to_wide_row_in_one_call(spark, manifest, tables, tmp_path):
    wide = {r["video_id"]: r for r in registry.export_rows(spark, manifest, tables, str(tmp_path / "wide")).collect()}
    assert set(wide) == {"full", "lost", "idle", "alone", "still", "faceless", "open"}
    row = wide["full"]
    assert row["03a_attention_num_bystanders_tracked"] == 2 and [p["person_id"] for p in json.loads(row["03a_attention_per_person_raw"])] == [7, 3]
    assert row["03c_acoustic_prosody_avg_prosody_scalar"] == -0.5 and row["03b_reasonable_emotion_avg_task_score"] > 0
    tasks = json.loads(row["03d_proxemic_kinematics_tasks_analyzed_raw"])
    assert [(t["task_id"], [p["person_id"] for p in t["per_person"]]) for t in tasks] == [("t_01", [7, 3])]
    assert tasks[0]["per_person"][0]["optical_flow_noise"] == 1.25 and set(tasks[0]["per_person"][0]) == {"person_id", "bbox_scale_delta_pct", "depth_anything_v2_delta", "proxemic_vector", "classified_action", "proxemic_confidence", "optical_flow_noise"}
    assert row["03e_affirmation_gesture_any_nod_detected"] and row["03g_shared_reality_any_social_reference"] is True
    moved = json.loads(row["03f_motor_resonance_tasks_analyzed_raw"])
    assert [t["task_id"] for t in moved] == ["t_01"] and moved[0]["ego_kinetic_chaos_score"] == 0.4 and [p["person_id"] for p in moved[0]["per_person"]] == [7]
    # 5 of 50 points of the crop's diagonal in 0.2 s; the motion peaks at 10.5, the body at 10.7
    assert moved[0]["per_person"][0] | {} == {"person_id": 7, "bystander_pose_velocity_peak": 1.0, "resonance_delay_sec": 0.2, "motor_resonance_detected": True, "empathy_scalar": 0.2, "mirroring_detected": False, "mirroring_scalar": 0.0}
    reason = {v: {n: wide[v][f"{n}_skipped_reason"] for n in records.SENTINELS} for v in wide}
    d, e, f, g = records.SENTINELS
    assert reason["full"] == dict.fromkeys(records.SENTINELS)
    assert reason["lost"] == {d: "no_output_produced", e: None, f: "file_not_found", g: "missing_video"}
    assert reason["idle"] == {d: "no_output_produced", e: "no_tasks", f: "no_bystanders_or_tasks", g: "no_bystanders_or_tasks"}
    assert reason["alone"] == {d: "no_output_produced", e: "no_attention_data", f: "no_bystanders_or_tasks", g: "no_bystanders_or_tasks"}
    assert reason["still"] == {d: "no_output_produced", e: "insufficient_trace", f: "no_ego_spikes", g: None}
    assert reason["faceless"] == {d: "no_output_produced", e: "no_attention_data", f: "no_pose_data", g: "missing_video"}
    assert reason["open"] == {d: "no_output_produced", e: "no_attention_data", f: "no_ego_spikes", g: "no_valid_tasks"}
    assert wide["still"]["03e_affirmation_gesture_any_nod_detected"] is None and wide["still"]["03e_affirmation_gesture_max_gesture_confidence"] is None
    assert {r for per in reason.values() for r in per.values()} - {None} == {r for rs in records.SENTINELS.values() for r in rs}


def test_missing_edges(spark, manifest, tables):
    given = records.observations(manifest) | tables
    less = {k: v for k, v in given.items() if k != "gaze"}
    with pytest.raises(KeyError, match="trace cannot run: gaze is missing"):
        with registry.run(spark, less, ["03e_affirmation_gesture"]):
            pass
    with pytest.raises(RuntimeError, match="03e_affirmation_gesture cannot run: traces is missing or empty"):
        with registry.run(spark, given | {"gaze": given["gaze"].limit(0)}, ["03e_affirmation_gesture"]):
            pass
    with pytest.raises(KeyError, match="03z"):
        registry.needed(registry.STEPS, given, ["03z"])
    order = [s.name for s in registry.needed(registry.STEPS, given)]
    assert order.index("trace") < order.index("03a_attention") < order.index("traces") < order.index("03e_affirmation_gesture") and order.index("03a_attention") < order.index("03b_reasonable_emotion")
    assert [s.name for s in registry.needed(registry.STEPS, less, ["03b_reasonable_emotion"])] == ["03b_reasonable_emotion"]
    assert [s.name for s in registry.needed(registry.STEPS, {"traces", "recordings", "tasks", "persons"}, ["03e_affirmation_gesture"])] == ["03e_affirmation_gesture"]


def test_layers_can_be_left_out_or_added(spark, manifest, tables, tmp_path):
    wide = registry.export_rows(spark, manifest, {k: tables[k] for k in ("audio", "flow")}, str(tmp_path / "some"))
    assert {c[:3] for c in wide.columns if c[:2] == "03"} == {"03c", "03g"}
    own = registry.Step("03z_counts", lambda boxes: boxes.groupBy("video_id").agg(F.count("*").alias("n")), ("boxes",))
    with registry.run(spark, records.observations(manifest), ["03z_counts"], (*registry.STEPS, own)) as made:
        assert {r["video_id"]: r["n"] for r in made["03z_counts"].collect()}["full"] == 128


def test_empty_manifest(spark, manifest, tables, tmp_path):
    wide = registry.export_rows(spark, manifest.limit(0), {k: v.limit(0) for k, v in tables.items() if k in ("flow", "depth", "noise", "poses")}, str(tmp_path / "none"))
    assert wide.count() == 0 and "03f_motor_resonance_skipped_reason" in wide.columns


def test_persons_without_measurements_have_no_row(spark):
    tasks = spark.createDataFrame([("v", "t_00", 1.0, 3.0)], "video_id string, task_id string, win_start double, win_end double")
    boxes = spark.createDataFrame([("v", 1, 1.0 + 0.5 * i, 0.0, 0.0, 100.0 + 20 * i, 100.0) for i in range(4)] + [("v", 2, 1.0, 0.0, 0.0, 9.0, 9.0)], "video_id string, person_id long, t double, x1 double, y1 double, x2 double, y2 double")
    none = spark.createDataFrame([], "video_id string, task_id string, person_id long, t double, depth double")
    noise = spark.createDataFrame([("v", "t_00", 15.005)], "video_id string, task_id string, noise double")
    assert layers.proxemics(boxes, none, noise.limit(0), tasks).collect() == []
    assert [(r["person_id"], r["optical_flow_noise"], r["area_delta_pct"]) for r in layers.proxemics(boxes, none, noise, tasks).collect()] == [(1, 15.01, 60.0)]
    trace = spark.createDataFrame([("v", p, 1 + i / 100, 0.1 if p == 1 or i % 2 else float("nan"), 0.0) for p, n in ((1, 4), (2, 100), (3, 12)) for i in range(n)] + [("v", 4, 1.5, 0.1, 0.0)] * 30, "video_id string, person_id long, t double, pitch_rad double, yaw_rad double")
    assert layers.gesture(trace, tasks, F.lit("none")).collect() == []
    flow = spark.createDataFrame([("v", "t_00", 1.0, 20.0, 20.0, 0.0, 0.0)], "video_id string, task_id string, t double, mean_mag double, p95_mag double, mean_dx double, mean_dy double")
    points = spark.createDataFrame([("v", "t_00", 1, 1.1, 5, 0.1, 0.1), ("v", "t_00", 2, 1.1, 5, 0.1, 0.1), ("v", "t_00", 2, 1.2, 5, 0.1234, 0.1)], "video_id string, task_id string, person_id long, t double, kpt int, x double, y double")
    assert [(r["person_id"], r["bystander_pose_velocity_peak"]) for r in layers.resonance(flow, points).collect()] == [(2, 0.47)]
