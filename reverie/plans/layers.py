"""The feature layers as plans from observation tables to task or person rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import maths as M
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import series as S
from ..operators.filters import gaze_threshold, pose_pick, sound_box
from ..sources.shared import stored

PERSON = ["video_id", "person_id"]
TASK = ["video_id", "task_id"]


#: The longest reaction window: points and windows meet in time buckets of this length.
WINDOW = max(end - start for start, end in C.REACTION_WINDOWS.values())


def within(points: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Points within the reaction windows (win_start, win_end) of the same keys; a task has one window."""
    if keys == TASK:
        return J.own_interval(points, windows, keys, "t", "win_start", "win_end")
    return J.interval_join(points, windows, keys, "t", "win_start", "win_end", WINDOW)


def tasks_of(videos: DataFrame, labels: str) -> DataFrame:
    """Valid labels of each recording as equal contiguous spans with ids t_00, t_01, ... and a velocity class."""
    from ..operators.filters import valid_tasks

    rows = videos.withColumn("__l", valid_tasks(F.col(labels))).select("video_id", "duration_sec", F.size("__l").alias("__n"), F.posexplode("__l").alias("__i", "task_label"))
    span = F.col("duration_sec") / F.col("__n")
    return rows.select(
        "video_id",
        T.task_id(F.col("__i")).alias("task_id"),
        "task_label",
        F.lit(1.0).alias("task_confidence"),
        T.velocity_class(F.col("task_label")).alias("task_velocity"),
        M.r(F.col("__i") * span, 2).alias("task_start_sec"),
        M.r((F.col("__i") + 1) * span, 2).alias("task_end_sec"),
        "duration_sec",
    )


def with_climax(tasks: DataFrame, flow: DataFrame, t: str = "t", value: str = "mean_mag") -> DataFrame:
    """Climax of each task from its motion, and the reaction window behind it; a task without motion has its start as climax."""
    own = J.interval_join(flow, tasks.select(*TASK, "task_start_sec", "task_end_sec"), [k for k in TASK if k in flow.columns], t, "task_start_sec", "task_end_sec")
    found = S.climax(own, TASK, t, value)
    out = tasks.join(found, TASK, "left").withColumn("climax_sec", M.r(F.coalesce("climax", "task_start_sec"), 2)).drop("climax")
    start, end = M.reaction_window(F.col("climax_sec"), F.col("task_velocity"), F.col("duration_sec"))
    return out.withColumns({"win_start": start, "win_end": end, "climax_method": F.when(F.col("peak").isNotNull(), "flow").otherwise("start")})


def attention(gaze: DataFrame, boxes: DataFrame, intrinsics: DataFrame, tolerance: float = 2.0, hands: DataFrame | None = None) -> DataFrame:
    """Score of every gaze sample: alignment of the gaze ray with the ray to the nearest box in time, or to a hand that it meets better.

    hands (video_id, t, hand_boxes array<array>) has the hands of the wearer by frame; the frame nearest in time counts, also
    if it shows none. Samples without a box within tolerance are left out.
    """
    near = J.nearest_join(gaze, boxes.select("video_id", "person_id", F.col("t").alias("box_t"), "x1", "y1", "x2", "y2"), PERSON, "t", "box_t", ["box_t"], tolerance, [*PERSON, "t"])
    near = near.where(F.col("box_t").isNotNull())
    if hands is not None:
        frames = hands.select("video_id", F.col("t").alias("hand_t"), "hand_boxes")
        near = J.nearest_join(near, frames, ["video_id"], "t", "hand_t", ["hand_t"], tolerance, [*PERSON, "t"])
    near = near.join(intrinsics, "video_id")
    focal = F.coalesce("focal", F.col("width").cast("double"))
    ray = M.unit(M.gaze_ray(F.col("pitch_rad"), F.col("yaw_rad")))

    def alignment(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        x = (x1 + x2) / 2 - F.coalesce("cx", F.col("width") / 2)
        y = (y1 + y2) / 2 - F.coalesce("cy", F.col("height") / 2)
        return M.dot(ray, M.unit([-x, -y, -focal]))

    person = alignment(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    hand = F.array_max(F.transform("hand_boxes", lambda b: alignment(*(F.get(b, i) for i in range(4))))) if hands is not None else F.lit(None).cast("double")
    scored = near.withColumns({"__person": person, "__hand": hand})
    best = F.greatest("__person", "__hand")
    return scored.select(
        *PERSON, M.r(F.col("t"), 2).alias("t"), M.r(F.col("pitch_rad"), 4).alias("pitch_rad"), M.r(F.col("yaw_rad"), 4).alias("yaw_rad"),
        M.attention_score(best).alias("score"), M.target_class(F.col("__person"), F.col("__hand")).alias("target"),
    )


def attention_summary(trace: DataFrame, target: str = "target") -> DataFrame:
    """Per person: mean, first time of the peak, sample variance, longest sustained run, engagement and the commonest target."""
    stats = trace.groupBy(*PERSON).agg(
        F.avg("score").alias("__m"), A.first_max_by(F.col("t"), F.col("score"), F.col("t")).alias("peak_t"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("__v")
    )
    held = S.sustained(trace, PERSON, "t", F.col("score") >= 0.7)
    out = stats.join(held, PERSON).join(A.dominant(trace, PERSON, target, "t"), PERSON)
    return out.select(
        *PERSON,
        M.r(F.col("__m"), 2).alias("average_attention_score"),
        F.col("peak_t").alias("peak_engagement_timestamp_sec"),
        M.r(F.col("__v"), 4).alias("attention_variance"),
        M.r(F.col("sustained"), 2).alias("sustained_engagement_sec"),
        ((F.col("__m") >= 0.5) | (F.col("sustained") > 2.0)).alias("is_engaged"),
        F.col("dominant").alias("gaze_target_classification"),
    )


def attention_aggregate(persons: DataFrame) -> DataFrame:
    return persons.groupBy("video_id").agg(
        F.count("*").alias("num_bystanders_tracked"), M.r(F.avg("average_attention_score"), 2).alias("mean_attention_all_persons"), F.bool_or("is_engaged").alias("any_person_engaged")
    )


def plain_attention_summary(trace: DataFrame) -> DataFrame:
    """The standalone analyser's other definition: population variance, engaged over 0.6, three digits."""
    return trace.groupBy(*PERSON).agg(
        M.r(F.avg("score"), 3).alias("mean_score"), M.r(F.var_pop("score"), 3).alias("variance"), (F.avg("score") > 0.6).alias("engaged")
    )


def emotion(samples: DataFrame, tasks: DataFrame, attention_scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slices, person scores, task scores) from emotion samples within the reaction windows."""
    keys = [*TASK, "person_id"]
    own = within(samples, tasks.select(*TASK, "climax_sec", "win_start", "win_end"), TASK)
    own = own.withColumn("emotion", T.folded_emotion(F.col("emotion")))
    slices = S.state_slices(own, keys, "t", "emotion", "magnitude")
    climaxes = tasks.select(*TASK, "climax_sec")
    persons = S.late_stage_score(slices.join(climaxes, TASK), keys, F.col("climax_sec"))
    return slices, persons, task_scores(persons, TASK, attention_scores, PERSON)


def task_scores(persons: DataFrame, task: list[str], attention_scores: DataFrame | None, person: list[str]) -> DataFrame:
    """Mean of late_stage_score over the persons of each task, weighted by their attention; a person without it weighs 1."""
    weighted = persons.withColumn("weight", F.lit(1.0))
    if attention_scores is not None:
        scores = attention_scores.select(*person, F.col("average_attention_score").alias("weight"), F.lit(0).alias("__o"))
        weighted = J.weighted_left_join(persons, scores, person, "weight", "__o")
    sums = weighted.groupBy(*task).agg(F.sum(F.col("late_stage_score") * F.col("weight")).alias("__n"), F.sum("weight").alias("__d"))
    return sums.select(*task, F.when(F.col("__d") > 0, M.r(F.col("__n") / F.col("__d"), 2)).otherwise(0.0).alias("task_aggregate_score"))


def prosody(audio: DataFrame, confident: float = 0.6) -> DataFrame:
    """Tone of each task's audio; transcripts' events count only where the strongest label is unsure. No audio is a neutral stub."""
    scores = M.filled_voice_scores(F.col("scores"))
    filled = audio.withColumns({"scores": scores, "max_dbfs": F.coalesce("max_dbfs", F.lit(-100.0)), "pitch_var": F.coalesce("pitch_var", F.lit(0.0))})
    top = M.first_largest([(F.lit(k), F.try_element_at("scores", F.lit(k))) for k in C.VOICE_LABELS])
    best = F.array_max(F.map_values("scores"))
    out = filled.withColumn("__tone", M.tone(F.col("scores"), F.col("max_dbfs"), F.col("pitch_var")))
    events = F.when(best < confident, T.audio_events(F.coalesce("sv_text", F.lit("")))).otherwise(F.array().cast("array<string>"))
    return out.select(
        *TASK, "max_dbfs", "pitch_var", top.alias("dominant_emotion"), best.alias("dominant_confidence"), events.alias("audio_events"),
        F.col("__tone.tone").alias("classified_acoustic_tone"), F.col("__tone.scalar").alias("prosody_scalar"),
    )


def proxemics(boxes: DataFrame, depth: DataFrame, noise: DataFrame, tasks: DataFrame, veto: float = 15.0) -> DataFrame:
    """Approach or avoidance per task and person, with the camera motion of the task (none: 0).

    Persons with fewer than two boxes in the window have no row. Tasks with too much camera motion are vetoed before depth is
    looked at; in the others, persons whose depth has no slope (fewer than two depths, or no time between them) have no row.
    """
    keys = [*TASK, "person_id"]
    windows = tasks.select(*TASK, "win_start", "win_end")
    own = within(boxes, windows, ["video_id"])
    area = A.area_delta(own, keys, "t", M.box_area(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    base = area.where(F.col("area_delta_pct").isNotNull()).join(noise.select(*TASK, "noise"), TASK, "left").withColumn("noise", F.coalesce("noise", F.lit(0.0)))
    shown = [*keys, M.r(F.col("area_delta_pct"), 2).alias("area_delta_pct")]
    motion = M.r(F.col("noise"), 2).alias("optical_flow_noise")
    vetoed = base.where(F.col("noise") > veto).select(*shown, F.lit(0.0).alias("depth_delta"), F.lit(0.0).alias("proxemic_vector"), F.lit("Neutral").alias("classified_action"), F.lit(0.0).alias("proxemic_confidence"), motion)
    calm = base.where(F.col("noise") <= veto)
    picked = S.evenly_picked(within(depth, windows, TASK).join(calm.select(*keys), keys, "left_semi"), keys, "t")
    known = calm.join(A.slope_span(picked, keys, "t", "depth").where(F.col("delta").isNotNull()), keys)
    vector = M.proxemic_vector(F.col("area_delta_pct"), F.col("delta"))
    scored = known.select(
        *shown, M.r(F.col("delta"), 4).alias("depth_delta"), vector.alias("proxemic_vector"), M.proxemic_action(vector).alias("classified_action"),
        M.r(M.proxemic_confidence(F.col("area_delta_pct"), F.col("delta")), 2).alias("proxemic_confidence"), motion,
    )
    return scored.unionByName(vetoed)


def require(df: DataFrame | None, layer: str, needed: str) -> DataFrame:
    """df, or an error if a layer's input from another one is missing or empty."""
    if df is None or df.isEmpty():
        raise RuntimeError(f"{layer} cannot run: {needed} is missing or empty")
    return df


def gesture(trace: DataFrame | None, tasks: DataFrame, model: Column, models: DataFrame | None = None) -> DataFrame:
    """Nods and shakes within the reaction windows. Without attention traces the run fails.

    model is the gaze model, which decides how many points may be filled in; it may be a column of models (one row for each video_id).

    Persons with fewer than five points in the window, without time between them, with too many points filled in, or with
    too few even samples to filter have no row; why a recording has none at all is told by its record.
    """
    keys = [*TASK, "person_id"]
    trace = require(trace, "03e_affirmation_gesture", "03a_attention")
    own = within(trace, tasks.select(*TASK, "win_start", "win_end"), ["video_id"])
    found = S.oscillations(own, keys, "t", "pitch_rad", "yaw_rad", least=5)
    found = found if models is None else found.join(models, "video_id", "left")
    usable = (F.col("interpolated") <= gaze_threshold(model)) & F.col("pitch_conf").isNotNull()
    out = found.where(usable).withColumn("__g", M.gesture(F.col("pitch_conf"), F.col("yaw_conf")))
    return out.select(
        *keys, M.r(F.col("pitch_hz"), 2).alias("pitch_oscillation_hz"), M.r(F.col("yaw_hz"), 2).alias("yaw_oscillation_hz"), M.r(F.col("interpolated"), 3).alias("interpolated_fraction"),
        F.col("__g.label").alias("gesture_detected"), M.r(F.col("__g.confidence"), 2).alias("confidence"),
    )


def body_keypoints(poses: DataFrame) -> DataFrame:
    """Keypoints (video_id, task_id, person_id, t, kpt, x, y) of a person's crop, from what a pose model found in it.

    poses has a row per found body and point: the crop's keys and t, x1 to y2 (the person's box in the frame), width, height,
    body (the number of the found body), kpt, x, y (within the crop), conf, and bx1 to by2 (the body's own box, null if the
    model gives none). Boxes are cut at the frame, and degenerate ones have no points. Of several bodies the one whose box meets
    the crop best counts, or without boxes the one of largest spread. Points count if they are among the six of arms,
    shoulders and hips and sure enough; coordinates are over the diagonal of the crop.
    """
    keys = [*TASK, "person_id", "t"]
    box = [b.cast("int") for b in M.clamp_box(*(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")), F.col("width"), F.col("height"))]
    rows = poses.withColumns(dict(zip(("__x1", "__y1", "__x2", "__y2"), box))).where(sound_box(*(F.col(c) for c in ("__x1", "__y1", "__x2", "__y2"))))
    rows = rows.withColumns({"__w": F.col("__x2") - F.col("__x1"), "__h": F.col("__y2") - F.col("__y1")})
    seen = F.col("conf") > 0
    extent = [F.max(F.when(seen, F.col(c))) - F.min(F.when(seen, F.col(c))) for c in ("x", "y")]
    own = [F.col(c) for c in ("bx1", "by1", "bx2", "by2")]
    met = F.when(own[0].isNotNull(), M.iou(own, [F.lit(0.0), F.lit(0.0), F.col("__w").cast("double"), F.col("__h").cast("double")]))
    bodies = rows.withColumn("__met", met).groupBy(*keys, "body").agg(F.max("__met").alias("__overlap"), (extent[0] * extent[1]).alias("__spread"))
    best = pose_pick(bodies, keys, "body", "__overlap", "__spread").select(*keys, "body")
    points = rows.join(best, [*keys, "body"]).where(F.col("kpt").isin(*C.BODY_POINTS) & (F.col("conf") > 0.5))
    diagonal = F.hypot(F.col("__w"), F.col("__h"))
    return points.select(*keys, "kpt", (F.col("x") / diagonal).alias("x"), (F.col("y") / diagonal).alias("y"))


def chaos(flow: DataFrame) -> DataFrame:
    """Most motion of each task: most_motion, its score, and whether any of it is a spike (see series.spikes)."""
    top = F.col("most_motion")
    tasks = flow.groupBy(*TASK).agg(F.max("p95_mag").alias("most_motion"))
    return tasks.withColumns({"ego_kinetic_chaos_score": M.r(M.normalised(top, 20.0), 2), "spiked": F.coalesce((top >= 3.0) & (top > 0.7 * top), F.lit(False))})


def resonance(flow: DataFrame, samples: DataFrame, angles: DataFrame | None = None, motion: DataFrame | None = None) -> DataFrame:
    """Motor resonance and mirroring per task and person from motion and keypoints (see body_keypoints); body angles come from the keypoints unless given.

    Motion is a task's, keypoints are a person's: they meet in time buckets of the task, so motion is never multiplied by persons.
    Persons with neither a velocity nor an angle, and tasks without motion, have no row. motion is chaos(flow), if it is known already.
    Samples with their velocity and angle are stored, as both are read more than once.
    """
    keys = [*TASK, "person_id"]
    means = dict(zip(("__sx", "__sy", "__hx", "__hy"), A.spine_means("kpt", "x", "y"))) if angles is None else {}
    moves = S.successive(samples.dropna(subset=keys), keys, "t", "kpt", "x", "y", **means)
    if angles is None:
        moves = moves.withColumn("angle", M.spine_angle(*(F.col(c) for c in means)))
        people, _ = stored(moves.where(F.col("moved") | F.col("angle").isNotNull()).select(*keys, "t", "velocity", "angle"), "resonance-moves")
        angles = people.where(F.col("angle").isNotNull()).select(*keys, F.col("t").alias("t_angle"), "angle")
    else:
        people = moves.where("moved").unionByName(angles.select(*keys), allowMissingColumns=True)
    motion = chaos(flow) if motion is None else motion
    spikes = S.spikes(flow, TASK, "p95_mag").select(*TASK, F.col("t").alias("spike_t"))
    people = people.groupBy(*keys).agg(*A.peak_of("t", "velocity"))
    peaks = people.where(F.col("peak").isNotNull())
    met = J.spike_response(spikes, peaks, TASK, "spike_t", "peak_t", each=["person_id"])
    out = people.join(motion.select(*TASK, "ego_kinetic_chaos_score"), TASK).join(met, keys, "left")
    mirrored = A.mirroring(flow, angles, TASK, "t", "mean_dy", "t_angle", "angle", each=["person_id"])
    out = out.join(mirrored, keys, "left")
    resonant = F.coalesce("detected", F.lit(False))
    peak = F.least(F.lit(10.0), F.coalesce("peak", F.lit(0.0)) / 0.5)  # least passes over nulls
    return out.select(
        *keys, "ego_kinetic_chaos_score", M.r(peak, 2).alias("bystander_pose_velocity_peak"),
        M.r(F.coalesce("delay", F.lit(0.0)), 2).alias("resonance_delay_sec"), resonant.alias("motor_resonance_detected"),
        F.when(resonant, M.r(F.least(F.lit(1.0), peak / 5), 2)).otherwise(0.0).alias("empathy_scalar"),
        F.coalesce("mirroring_detected", F.lit(False)).alias("mirroring_detected"), M.r(F.coalesce("mirroring_scalar", F.lit(0.0)), 2).alias("mirroring_scalar"),
    )


def shared_reality(flow: DataFrame, boxes: DataFrame, tasks: DataFrame, videos: DataFrame) -> DataFrame:
    """Whether the wearer turned the camera to a bystander after the climax."""
    windows = tasks.select(*TASK, "win_start", "win_end")
    shift = A.camera_shift(within(flow, windows, TASK), TASK, "mean_dx", "mean_dy")
    centre = (F.col("x1") + F.col("x2")) / 2 / F.col("width"), (F.col("y1") + F.col("y2")) / 2 / F.col("height")
    inside = boxes.join(videos.select("video_id", "width", "height"), "video_id").select("video_id", "t", *(c.alias(n) for n, c in zip(("__cx", "__cy"), centre))).where(S.central(F.col("__cx"), F.col("__cy")))
    centred = S.tail_centred(within(inside, windows, ["video_id"]), TASK, "t", "win_start", "win_end", F.col("__cx"), F.col("__cy"))
    out = tasks.select(*TASK).join(shift, TASK, "left").join(centred, TASK, "left").join(videos.select("video_id", "width", "height"), "video_id", "left")
    out = out.fillna({"shift_x": 0.0, "shift_y": 0.0, "centred": False})
    sought = M.social_reference(F.col("centred"), F.col("shift_x"), F.col("shift_y"), F.col("width"), F.col("height"))
    return out.select(*TASK, "shift_x", "shift_y", F.col("centred").alias("bystander_centered_in_fov"), F.coalesce(sought, F.lit(False)).alias("social_reference_sought"))
