"""Social presence: which recordings show somebody else than the wearer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as L

KEY = "video_id"


def bystanders(detections: DataFrame, verify: bool) -> DataFrame:
    """Detections that are somebody else: no part of the wearer, head and shoulder visible, and with verify not the wearer's own face.

    detections: video_id, frame, y1, y2, height, keypoints (confidences, null without a pose), face_up (null without an answer).
    """
    y1, y2, height = F.col("y1"), F.col("y2"), F.col("height")
    kept = detections.where(~L.wearer_artifact(y1, y2, height) & L.head_and_shoulder(F.col("keypoints")))
    return kept.where(L.chin_gate(y2, height, F.col("face_up"))) if verify else kept


def presence(videos: DataFrame, detections: DataFrame, answers: DataFrame | None = None, least: int = 2, budget: int = 5) -> DataFrame:
    """video_id and present, for every recording: the fast decision.

    Without answers, bystanders in at least so many frames. With answers (video_id, frame, several, stereo: what a model says of a
    frame, null where it says nothing), the first budget frames with bystanders are asked, at least so many must show several
    persons, and a recording whose first such frame is side by side stereo is out.
    """
    own = bystanders(detections, answers is not None)
    frames = own.select(KEY, "frame").distinct()
    if answers is None:
        passed = L.consistent(frames, KEY, "frame", least).select(KEY).distinct()
    else:
        asked = frames.join(answers, [KEY, "frame"], "left")
        sure = L.confirmed(asked, KEY, "frame", F.coalesce("several", F.lit(False)), budget, least).where("confirmed")
        first = L.first_verdict(asked.withColumn("stereo", F.coalesce("stereo", F.lit(False))), KEY, "frame", "stereo").where("stereo")
        passed = sure.select(KEY).join(first, KEY, "left_anti")
    return videos.select(KEY).distinct().join(passed.withColumn("__p", F.lit(True)), KEY, "left").select(KEY, F.coalesce("__p", F.lit(False)).alias("present"))


def present_detections(detections: DataFrame, answers: DataFrame | None = None, least: int = 2, budget: int = 5) -> DataFrame:
    """The bystanders of every recording, or with answers of those that pass them; the full mode, which does not ask for a count of frames without answers."""
    own = bystanders(detections, answers is not None)
    if answers is None:
        return own
    return own.join(presence(own, detections, answers, least, budget).where("present").select(KEY), KEY, "left_semi")


def kept_recordings(videos: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recordings to keep after the streaming filter: those without a decision, for whatever reason, stay."""
    return videos.join(decisions, KEY, "left").where(L.purge(F.col("present"))).select(*(videos[c] for c in videos.columns))
