"""Word lists, label maps, patterns and thresholds that results depend on."""

FAST_WORDS = ("drop", "slip", "fall", "throw", "hit", "impact", "jump", "run", "fast", "accident", "shatter")
SLOW_WORDS = ("read", "write", "think", "solve", "puzzle", "watch", "look", "sit", "slow", "wait", "rest")
SOLO_SCENARIOS = (
    "crafting",
    "reading books",
    "watching tv",
    "listening to music",
    "sleeping",
    "daily hygiene",
    "fixing pc",
    "on a screen",
    "play with cellphone",
    "playing games / video games",
    "assembling a puzzle",
    "writing on book",
    "reviewing flash cards",
    "crossword puzzle",
    "potting plants",
    "talking on the phone",
)
INVALID_TASKS = ("idling", "no clear task", "ambiguous activity")
SUPPORTED_DATASETS = ("ego4d",)
POSITIVE_EMOTIONS = ("joy", "amusement", "relief")
NEGATIVE_EMOTIONS = ("anger", "disgust", "fear", "sadness")
DEFAULT_EXPECTATIONS = {
    "positive_emotions": ["joy", "amusement", "relief"],
    "negative_emotions": ["anger", "disgust", "fear", "sadness"],
    "neutral_baseline": ["neutral", "surprise"],
}
EMOTION_FOLD = {"contempt": "disgust", "happiness": "joy", "unknown": "neutral"}
VOICE_LABELS = ("angry", "happy", "sad", "surprised", "fearful", "neutral", "disgusted", "other", "unknown")
AUDIO_EVENTS = ("laughter", "applause", "cough", "crying", "sneeze")
GAZE_THRESHOLDS = {"l2cs_net_3d_gaze": 0.3, "crossgaze": 0.2, "3dgazenet": 0.25}
#: What a gaze is classified as aimed at: the wearer's camera, or the wearer's hands
GAZE_TARGETS = ("Camera", "POV_Actor_Hands")
#: velocity -> seconds after the climax at which its reaction window starts and ends
REACTION_WINDOWS = {"fast": (0.5, 2.0), "medium": (1.0, 3.0), "slow": (2.0, 6.0)}
#: Keypoints of shoulders, wrists and hips
BODY_POINTS = (5, 6, 9, 10, 11, 12)
LEAK_PATTERNS = (r"^data:image/[a-z]+;base64,", r"^/[Vv]olumes/|^/Users/|^/tmp/")
#: layer -> (path in the task or person record, aggregate, column suffix)
SUMMARIES = {
    "03b_reasonable_emotion": [("task_aggregate_score", "mean", "avg_task_score")],
    "03c_acoustic_prosody": [("prosody_scalar", "mean", "avg_prosody_scalar")],
    "03d_proxemic_kinematics": [
        ("per_person.proxemic_confidence", "max", "max_proxemic_confidence"),
        ("per_person.proxemic_vector", "max_abs", "max_abs_proxemic_vector"),
        ("per_person.classified_action", "any_eq:Approach", "any_approach_detected"),
        ("per_person.classified_action", "any_eq:Retreat", "any_retreat_detected"),
    ],
    "03e_affirmation_gesture": [
        ("per_person.confidence", "max", "max_gesture_confidence"),
        ("per_person.gesture_detected", "any_eq:affirming_nod", "any_nod_detected"),
        ("per_person.gesture_detected", "any_eq:negating_shake", "any_shake_detected"),
    ],
    "03f_motor_resonance": [
        ("ego_kinetic_chaos_score", "max", "max_ego_chaos_score"),
        ("per_person.empathy_scalar", "max", "max_empathy_scalar"),
        ("per_person.motor_resonance_detected", "any", "any_motor_resonance"),
        ("per_person.mirroring_scalar", "max", "max_mirroring_scalar"),
        ("per_person.mirroring_detected", "any", "any_mirroring"),
    ],
    "03g_shared_reality": [
        ("social_reference_sought", "any", "any_social_reference"),
        ("bystander_centered_in_fov", "any", "any_bystander_centered"),
    ],
}
#: The registry above looks for labels that the proxemic layer never gives; this one looks for those that it gives.
CORRECTED_ACTIONS = {"any_eq:Approach": "any_eq:Approach_Intervention", "any_eq:Retreat": "any_eq:Avoidance"}
