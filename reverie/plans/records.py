"""Records of the layers: one for each recording, with its tasks and persons in the order of the source, or the reason why there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.shared import stored
from . import layers as L

KEY = "video_id"
#: Reasons that a layer gives for a recording without results, the first that holds.
SENTINELS = {
    "03d_proxemic_kinematics": ("no_output_produced",),
    "03e_affirmation_gesture": ("no_attention_data", "no_tasks", "insufficient_trace"),
    "03f_motor_resonance": ("file_not_found", "no_bystanders_or_tasks", "no_ego_spikes", "no_pose_data"),
    "03g_shared_reality": ("missing_video", "no_bystanders_or_tasks", "no_valid_tasks"),
}


def skipped_reason(layer: str, holds: dict[str, Column]) -> Column:
    """The first reason of the layer that holds, else null."""
    return F.coalesce(*(F.when(holds[reason], reason) for reason in SENTINELS[layer] if reason in holds))


def observations(manifest: DataFrame) -> dict[str, DataFrame]:
    """recordings, tasks, persons and boxes of a manifest.

    recordings: video_id, duration_sec, fps, width, height, found (the file is there: true unless the manifest has video_found), and
    how many tasks and bystanders it lists. tasks: task_pos (place in the list), task_id, task_label, climax_sec, win_start and
    win_end (null unless the reaction window has two ends). persons: person_pos, person_id. boxes: person_id, t, x1 to y2, conf;
    persons whose arrays differ in length have none. Entries without an id are left out, and of repeated ids the row stays.
    """
    key = F.coalesce(*(F.col(c) for c in ("id", KEY) if c in manifest.columns)).cast("string")
    rows = manifest.withColumn("__id", key).where(F.coalesce("__id", F.lit("")) != "")
    has = set(rows.columns)

    def given(name: str, kind: str, default: Column | None = None) -> Column:
        own = F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
        return (F.coalesce(own, default) if default is not None else own).alias(name)

    def listed(name: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(F.size(name), F.lit(0))) if name in has else F.lit(0)

    recordings = rows.select(
        F.col("__id").alias(KEY), given("duration_sec", "double"), given("fps", "double"), given("width", "double"), given("height", "double"),
        given("video_found", "boolean", F.lit(True)).alias("found"), listed("identified_tasks").alias("n_tasks"), listed("bystander_detections").alias("n_bystanders"),
    )
    tasks = rows.select(F.col("__id").alias(KEY), F.posexplode("identified_tasks").alias("task_pos", "task"))
    window = F.col("task.task_temporal_metadata.task_reaction_window_sec")
    whole = F.size(window) == 2
    tasks = tasks.select(
        KEY, "task_pos", F.coalesce("task.task_id", F.lit("unknown")).alias("task_id"), F.col("task.task_label").alias("task_label"),
        F.coalesce(F.col("task.task_temporal_metadata.task_climax_sec").cast("double"), F.lit(0.0)).alias("climax_sec"),
        F.when(whole, F.get(window, F.lit(0)).cast("double")).alias("win_start"), F.when(whole, F.get(window, F.lit(1)).cast("double")).alias("win_end"),
    )
    people = rows.select(F.col("__id").alias(KEY), F.posexplode("bystander_detections").alias("person_pos", "p"))
    same = (F.size("p.timestamps_sec") == F.size("p.bounding_boxes")) & F.col("p.person_id").isNotNull()
    confidence = F.col("p.detection_confidence") if "detection_confidence" in people.schema["p"].dataType.names else F.array().cast("array<double>")
    samples = people.where(same).select(KEY, F.col("p.person_id").alias("person_id"), confidence.alias("c"), F.posexplode(F.arrays_zip(F.col("p.timestamps_sec").alias("t"), F.col("p.bounding_boxes").alias("b"))).alias("i", "s"))
    box = [F.get(F.col("s.b"), F.lit(j)).cast("double").alias(n) for j, n in enumerate(("x1", "y1", "x2", "y2"))]
    return {
        "recordings": recordings,
        "tasks": tasks,
        "persons": people.where(F.col("p.person_id").isNotNull()).groupBy(KEY, F.col("p.person_id").alias("person_id")).agg(F.min("person_pos").alias("person_pos")),
        "boxes": samples.select(KEY, "person_id", F.col("s.t").cast("double").alias("t"), *box, F.get("c", "i").cast("double").alias("conf")),
    }


def windows(tasks: DataFrame) -> DataFrame:
    """Tasks that have a reaction window."""
    return tasks.where(F.col("win_start").isNotNull() & F.col("win_end").isNotNull())


def evidence(recordings: DataFrame, signs: dict[str, DataFrame]) -> DataFrame:
    """recordings with a boolean for each sign: whether any row of that table is of the recording.

    All tables are stacked and grouped once, so the outcomes of all children take one shuffle; rows are combined before it.
    """
    stacked = reduce(DataFrame.union, (df.select(KEY, F.lit(name).alias("__sign")) for name, df in signs.items()))
    found = stacked.groupBy(KEY).agg(*(F.bool_or(F.col("__sign") == name).alias(name) for name in signs))
    out = recordings.join(found, KEY, "left")
    return out.withColumns({name: F.coalesce(name, F.lit(False)) for name in signs})


def folded(tasks: DataFrame, task_fields: list[str], persons: DataFrame | None = None, order: DataFrame | None = None, person_fields: dict[str, str] | None = None) -> DataFrame:
    """video_id and tasks_analyzed: an array of the tasks of each recording, each with task_id, its fields and per_person.

    tasks has task_pos and task_id; persons a row for each task and person, which order (video_id, person_id, person_pos)
    places; person_fields names their columns in the record. With persons, tasks without any are left out.
    """
    rows = tasks
    if persons is not None:
        named = F.struct("person_id", *(F.col(c).alias(n) for c, n in person_fields.items()))
        placed = persons.join(order, [KEY, "person_id"], "left").select(KEY, "task_id", F.struct(F.coalesce("person_pos", F.lit(1 << 30)).alias("at"), named.alias("p")).alias("__p"))
        people = placed.groupBy(KEY, "task_id").agg(F.array_sort(F.collect_list("__p")).alias("__ps"))
        rows = rows.join(people, [KEY, "task_id"]).withColumn("per_person", F.transform("__ps", lambda x: x["p"]))
        task_fields = [*task_fields, "per_person"]
    one = F.struct(F.col("task_pos").alias("at"), F.struct("task_id", *task_fields).alias("task"))
    return rows.groupBy(KEY).agg(F.array_sort(F.collect_list(one)).alias("__t")).select(KEY, F.transform("__t", lambda x: x["task"]).alias("tasks_analyzed"))


def with_reasons(layer: str, recordings: DataFrame, found: DataFrame, holds: dict[str, Column]) -> DataFrame:
    """A record for every recording: its tasks, or an empty array and the first reason that holds."""
    out = recordings.join(found.withColumn("__any", F.lit(True)), KEY, "left")
    return out.select(
        KEY, F.lit(layer).alias("layer"), F.coalesce("tasks_analyzed", F.array().cast(found.schema["tasks_analyzed"].dataType)).alias("tasks_analyzed"),
        F.when(F.col("__any").isNull(), skipped_reason(layer, holds)).alias("skipped_reason"),
    )


def with_results(layer: str, found: DataFrame) -> DataFrame:
    """Records of a layer that leaves out recordings without results, so that they are tried again."""
    return found.select(KEY, F.lit(layer).alias("layer"), *(c for c in found.columns if c != KEY))


def attention(trace: DataFrame, persons: DataFrame, model: str = "l2cs_net_3d_gaze", burst_fps: float = 16.0) -> DataFrame:
    """Records of the attention layer from its traces: persons with their summary and trace, and the aggregate of the recording."""
    points = F.array_sort(F.collect_list(F.struct("t", "score", "pitch_rad", "yaw_rad", "target")))
    summary = L.attention_summary(trace)
    people = summary.join(trace.groupBy(*L.PERSON).agg(points.alias("attention_trace")), L.PERSON).join(persons, L.PERSON, "left")
    own = [c for c in people.columns if c not in (KEY, "person_pos")]
    one = F.struct(F.coalesce("person_pos", F.lit(1 << 30)).alias("at"), F.struct(*own).alias("p"))
    listed = people.groupBy(KEY).agg(F.array_sort(F.collect_list(one)).alias("__p"))
    total = L.attention_aggregate(summary)
    meta = F.struct(F.lit(model).alias("model_used"), F.lit(8.0).alias("sampling_fps_effective"), F.lit(burst_fps).alias("sampling_fps_burst"), F.lit(f"adaptive_8_to_{int(burst_fps)}_fps").alias("sampling_strategy"))
    found = listed.join(total, KEY).select(KEY, meta.alias("processing_meta"), F.transform("__p", lambda x: x["p"]).alias("per_person"), F.struct(*(c for c in total.columns if c != KEY)).alias("aggregate"))
    return with_results("03a_attention", found)


def emotion(samples: DataFrame, tasks: DataFrame, persons: DataFrame, attention_records: DataFrame | None = None) -> DataFrame:
    """Records of the emotion layer; a task's score is weighted by the persons' attention where there are records of it."""
    weights = None
    if attention_records is not None:
        weights = attention_records.select(KEY, F.explode("per_person").alias("p")).select(KEY, "p.person_id", "p.average_attention_score")
    own = windows(tasks)
    slices, scores, totals = L.emotion(samples, own, weights)
    one = F.struct(
        "slice_id", F.array("slice_start", "slice_end").alias("window_sec"), F.array("from_state", "to_state").alias("emotion_pair"), "terminal_magnitude",
        F.col("direction").alias("classified_direction"), F.col("scalar").alias("slice_success_scalar"),
    )
    lists = slices.groupBy(*L.TASK, "person_id").agg(F.array_sort(F.collect_list(one)).alias("temporal_slices"))
    people = scores.join(lists, [*L.TASK, "person_id"])
    rows = own.join(totals, L.TASK).withColumn("task_reaction_window_sec", F.array("win_start", "win_end"))
    fields = {"temporal_slices": "temporal_slices", "late_stage_score": "late_stage_weighted_success_score"}
    return with_results("03b_reasonable_emotion", folded(rows, ["task_label", "task_reaction_window_sec", "task_aggregate_score"], people, persons, fields))


def prosody(audio: DataFrame | None, tasks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Records of the prosody layer: every task with a window of a recording whose file is there; one without audio is a neutral stub."""
    own = windows(tasks).join(recordings.where("found").select(KEY), KEY, "left_semi")
    heard = own.select(*L.TASK)
    kinds = {"max_dbfs": "double", "pitch_var": "double", "scores": "map<string,double>", "sv_text": "string"}
    if audio is None:
        heard = heard.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    else:
        heard = heard.join(audio.select(*L.TASK, *kinds), L.TASK, "left")
    scores = F.struct(*(F.try_element_at("scores", F.lit(k)).alias(k) for k in C.VOICE_LABELS))
    full = L.prosody(heard).join(heard.select(*L.TASK, L.M.filled_voice_scores(F.col("scores")).alias("scores")), L.TASK)
    metrics = F.struct(
        F.col("max_dbfs").alias("max_amplitude_dbFS"), F.col("pitch_var").alias("pitch_contour_variance"), scores.alias("emotion_scores"), "dominant_emotion",
        F.col("dominant_confidence").alias("dominant_emotion_confidence"), "audio_events",
    )
    rows = own.join(full, L.TASK).withColumns({"prosody_metrics": metrics, "task_reaction_window_sec": F.array("win_start", "win_end")})
    return with_results("03c_acoustic_prosody", folded(rows, ["task_reaction_window_sec", "prosody_metrics", "classified_acoustic_tone", "prosody_scalar"]))


def proxemics(recordings: DataFrame, tasks: DataFrame, persons: DataFrame, boxes: DataFrame, depth: DataFrame, noise: DataFrame) -> DataFrame:
    """Records of the proxemic layer. A recording whose file is not there has no output, whatever was observed of it."""
    layer = "03d_proxemic_kinematics"
    there = recordings.where("found").select(KEY)
    own = windows(tasks).join(there, KEY, "left_semi")
    fields = {"area_delta_pct": "bbox_scale_delta_pct", "depth_delta": "depth_anything_v2_delta"} | {c: c for c in ("proxemic_vector", "classified_action", "proxemic_confidence", "optical_flow_noise")}
    found = folded(own, [], L.proxemics(boxes, depth, noise, own), persons, fields)
    return with_reasons(layer, recordings.select(KEY), found, {"no_output_produced": F.lit(True)})


def traces(attention_records: DataFrame) -> DataFrame:
    """video_id, model, person_id, t, pitch_rad, yaw_rad of the records of attention."""
    people = attention_records.select(KEY, F.col("processing_meta.model_used").alias("model"), F.explode("per_person").alias("p"))
    return people.select(KEY, "model", "p.person_id", F.explode("p.attention_trace").alias("x")).select(KEY, "model", "person_id", "x.t", "x.pitch_rad", "x.yaw_rad")


def gesture(recordings: DataFrame, tasks: DataFrame, persons: DataFrame, trace: DataFrame) -> DataFrame:
    """Records of the gesture layer, from the traces of attention with the gaze model of each recording; no traces at all fail the run."""
    layer = "03e_affirmation_gesture"
    models = L.require(trace, layer, "03a_attention").groupBy(KEY).agg(F.first("model").alias("model"))
    own = windows(tasks)
    rows = L.gesture(trace, own, F.col("model"), models)
    fields = {c: c for c in ("pitch_oscillation_hz", "yaw_oscillation_hz", "interpolated_fraction", "gesture_detected", "confidence")}
    seen = evidence(recordings.select(KEY, "n_tasks"), {"traced": models})
    holds = {"no_attention_data": ~F.col("traced"), "no_tasks": F.col("n_tasks") == 0, "insufficient_trace": F.lit(True)}
    return with_reasons(layer, seen, folded(own, [], rows, persons, fields), holds)


def resonance(recordings: DataFrame, tasks: DataFrame, persons: DataFrame, flow: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Records of the resonance layer from the motion and keypoints within the reaction windows."""
    layer = "03f_motor_resonance"
    there = recordings.where(F.col("found") & (F.col("n_tasks") > 0) & (F.col("n_bystanders") > 0)).select(KEY)
    own = windows(tasks).join(there, KEY, "left_semi")
    spans = own.select(*L.TASK, "win_start", "win_end")
    moved, points = (L.within(x, spans, L.TASK).drop("win_start", "win_end") for x in (flow, keypoints))
    motion, _ = stored(L.chaos(moved), "resonance-motion")
    rows = L.resonance(moved, points, motion=motion)
    chaos = own.join(motion.select(*L.TASK, "ego_kinetic_chaos_score"), L.TASK)  # tasks without persons go when the record is folded
    fields = {c: c for c in ("bystander_pose_velocity_peak", "resonance_delay_sec", "motor_resonance_detected", "empathy_scalar", "mirroring_detected", "mirroring_scalar")}
    seen = evidence(recordings.select(KEY, "found", "n_tasks", "n_bystanders"), {"spiked": motion.where("spiked")})
    holds = {
        "file_not_found": ~F.col("found"),
        "no_bystanders_or_tasks": (F.col("n_tasks") == 0) | (F.col("n_bystanders") == 0),
        "no_ego_spikes": ~F.col("spiked"),
        "no_pose_data": F.lit(True),
    }
    return with_reasons(layer, seen, folded(chaos, ["ego_kinetic_chaos_score"], rows, persons, fields), holds)


def shared_reality(recordings: DataFrame, tasks: DataFrame, boxes: DataFrame, flow: DataFrame) -> DataFrame:
    """Records of the shared-reality layer; a recording without a frame size or rate counts as missing."""
    layer = "03g_shared_reality"
    sound = F.col("found") & (F.coalesce("width", F.lit(0.0)) > 0) & (F.coalesce("height", F.lit(0.0)) > 0) & (F.coalesce("fps", F.lit(0.0)) > 0)
    seen = recordings.withColumn("sound", sound)
    there = seen.where(F.col("sound") & (F.col("n_tasks") > 0) & (F.col("n_bystanders") > 0))
    own = windows(tasks).join(there.select(KEY), KEY, "left_semi")
    rows = L.shared_reality(flow, boxes, own, there.select(KEY, "width", "height"))
    vector = F.array("shift_x", "shift_y").alias("post_climax_camera_shift_vector")
    out = own.join(rows.select(*L.TASK, vector, "bystander_centered_in_fov", "social_reference_sought"), L.TASK)
    holds = {"missing_video": ~F.col("sound"), "no_bystanders_or_tasks": (F.col("n_tasks") == 0) | (F.col("n_bystanders") == 0), "no_valid_tasks": F.lit(True)}
    return with_reasons(layer, seen.select(KEY, "sound", "n_tasks", "n_bystanders"), folded(out, ["post_climax_camera_shift_vector", "bystander_centered_in_fov", "social_reference_sought"]), holds)
