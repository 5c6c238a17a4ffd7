"""Records that read their observations once."""

from reverie.plans import records as R


def test_samples_of_a_resonance_record_are_placed_once(spark):
    recordings = spark.createDataFrame([(v, True, 1, 1) for v in "abc"], "video_id string, found boolean, n_tasks int, n_bystanders int")
    tasks = spark.createDataFrame([(v, 0, "t", 0.0, 4.0) for v in "abc"], "video_id string, task_pos int, task_id string, win_start double, win_end double")
    persons = spark.createDataFrame([(v, 1, 0) for v in "abc"], "video_id string, person_id int, person_pos int")
    moves = [("a", 1.0, 10.0), ("a", 1.5, 2.0), ("b", 1.0, 2.9), ("c", 1.0, 3.0), ("c", 9.0, 20.0)]  # the last lies beyond the window
    flow = spark.createDataFrame([(v, "t", t, m, m, 0.0, -2.0) for v, t, m in moves], "video_id string, task_id string, t double, mean_mag double, p95_mag double, mean_dx double, mean_dy double")
    points = [("a", t, k, x, y) for t, x in ((0.9, 0.0), (1.25, 0.35)) for k, y in ((5, 0.2), (11, 0.6))]
    keypoints = spark.createDataFrame([(v, "t", 1, t, k, x if k == 5 else 0.0, y) for v, t, k, x, y in points], "video_id string, task_id string, person_id int, t double, kpt int, x double, y double")
    out = R.resonance(recordings, tasks, persons, flow, keypoints)
    assert "kpt" not in out._jdf.queryExecution().executedPlan().toString()  # samples, velocities and angles are made before, not by each reader
    got = {r["video_id"]: r for r in out.collect()}
    assert {v: r["skipped_reason"] for v, r in got.items()} == {"a": None, "b": "no_ego_spikes", "c": "no_pose_data"}
    (task,) = got["a"]["tasks_analyzed"]
    assert task["task_id"] == "t" and task["ego_kinetic_chaos_score"] == 0.5
    (person,) = task["per_person"]
    assert (person["bystander_pose_velocity_peak"], person["resonance_delay_sec"], person["motor_resonance_detected"], person["mirroring_detected"]) == (1.0, 0.25, True, True)
