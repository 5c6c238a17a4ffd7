"""Rounding, geometry, and the signal scores of the layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def r(x: Column, digits: int) -> Column:
    """Half away from zero in the floor form, which does not depend on an engine's round()."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def py_round(x: Column, digits: int) -> Column:
    """Nearest decimal to the exact binary value, half to even, as in Python: the product with the scale is carried with its rounding error."""
    scale = float(10**digits)
    a = F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # the upper half of the digits of a, by Veltkamp's split
    whole = F.floor(a * scale)
    beyond = (a * scale - whole - 0.5) + ((high * scale - a * scale) + (a - high) * scale)
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(whole, F.lit(2)) == 1))
    return F.signum(x) * (whole + F.when(up, 1).otherwise(0)) / scale


def gesture(nod: Column, shake: Column, least: float = 0.6, apart: float = 0.15) -> Column:
    """struct<label, confidence>: a nod or shake above least; where both are and differ by less than apart, an ambiguous wobble with their mean."""
    both = (nod > least) & (shake > least) & (F.abs(nod - shake) < apart)
    label = F.when(both, "ambiguous_wobble").when((nod > least) & (nod > shake), "affirming_nod").when(shake > least, "negating_shake").otherwise("none")
    sure = F.when(both, (nod + shake) / 2).when((nod > least) & (nod > shake), nod).when(shake > least, shake).otherwise(0.0)
    return F.struct(label.alias("label"), sure.alias("confidence"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def gaze_ray(pitch: Column, yaw: Column) -> list[Column]:
    return [-F.cos(yaw) * F.sin(pitch), -F.sin(yaw), -F.cos(yaw) * F.cos(pitch)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b)))


def unit(v: list[Column]) -> list[Column]:
    """v over its norm; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return [F.when(norm > 0, x / norm).otherwise(x) for x in v]


def attention_score(alignment: Column) -> Column:
    return r(clip((alignment - 0.5) * 2, 0.0, 1.0), 2)


def target_class(bystander: Column, hand: Column) -> Column:
    """The hand wins only with a strictly larger alignment; without a hand it is the camera."""
    return F.when(hand > bystander, C.GAZE_TARGETS[1]).otherwise(C.GAZE_TARGETS[0])


def softmax_angle(logits: Column, step: float = 4.0, offset: float = 180.0) -> Column:
    """Radians of the expected bin under a softmax over equal bins."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.zip_with(e, F.sequence(F.lit(0), F.size(logits) - 1), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return F.radians(weighted / total * step - offset)


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def iou(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = box_area(*a) + box_area(*b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 0) -> list[Column]:
    """Box grown by pad and cut at the frame; a degenerate one has x2 <= x1 or y2 <= y1."""
    zero = F.lit(0)
    return [F.greatest(zero, x1 - pad), F.greatest(zero, y1 - pad), F.least(width, x2 + pad), F.least(height, y2 + pad)]


def proxemic_vector(area_pct: Column, depth_delta: Column) -> Column:
    v = 0.4 * clip(area_pct / 50, -1.0, 1.0) + 0.6 * clip(-2 * depth_delta, -1.0, 1.0)
    return F.when(F.abs(v) < 0.05, 0.0).otherwise(r(v, 2))


def proxemic_action(vector: Column, threshold: float = 0.3) -> Column:
    return F.when(vector > threshold, "Approach_Intervention").when(vector < -threshold, "Avoidance").otherwise("Neutral")


def proxemic_confidence(area_pct: Column, depth_delta: Column) -> Column:
    return 1 - F.abs(F.signum(area_pct) - F.signum(-depth_delta)) / 2


def tone(scores: Column, dbfs: Column, pitch_variance: Column) -> Column:
    """struct<tone, scalar> from the nine voice labels, loudness and normalised pitch variance; the first of equal scores wins."""

    def s(k: str) -> Column:
        return F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))

    ranked = [
        ("Alarming", s("angry") + s("fearful") + F.when(dbfs > -20, 0.3).otherwise(0.0), -1.0),
        ("Soothing", s("happy") + s("surprised") + pitch_variance * 0.5, 1.0),
        ("Discouraging", s("sad") + F.when(dbfs < -35, 0.3).otherwise(0.0), -0.5),
        ("Neutral", s("neutral"), 0.0),
    ]
    return first_largest([(F.struct(F.lit(n).alias("tone"), F.lit(v).alias("scalar")), x) for n, x, v in ranked], 0.3, F.struct(F.lit("Neutral").alias("tone"), F.lit(0.0).alias("scalar")))


def first_largest(choices: list[tuple[Column, Column]], least: float | None = None, otherwise: Column | None = None) -> Column:
    """The value of the largest score, the first one on ties; otherwise where that score is under least."""
    top = F.greatest(*(x for _, x in choices))
    out = F.when(top < least, otherwise) if least is not None else F.when(F.lit(False), choices[0][0])
    for value, x in choices:
        out = out.when(x == top, value)
    return out


def filled_voice_scores(scores: Column) -> Column:
    """All nine labels, missing ones 0; a null map is neutral."""
    labels = F.array(*map(F.lit, C.VOICE_LABELS))
    values = F.transform(labels, lambda k: F.coalesce(F.try_element_at(scores, k), F.lit(0.0)))
    neutral = F.transform(labels, lambda k: F.when(k == "neutral", 1.0).otherwise(0.0))
    return F.map_from_arrays(labels, F.when(scores.isNull(), neutral).otherwise(values))


def reaction_window(climax: Column, velocity: Column, duration: Column) -> list[Column]:
    end = r(duration, 2)

    def at(i: int) -> Column:
        out = climax + C.REACTION_WINDOWS["medium"][i]
        for v in ("fast", "slow"):
            out = F.when(velocity == v, climax + C.REACTION_WINDOWS[v][i]).otherwise(out)
        return F.least(r(out, 2), end)

    return [at(0), at(1)]


def spine_angle(sx: Column, sy: Column, hx: Column, hy: Column) -> Column:
    return F.atan2(sy - hy, sx - hx)


def normalised(value: Column, most: float) -> Column:
    return F.least(F.lit(1.0), value / most)


def social_reference(centred: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    return centred & (F.hypot(dx, dy) > 0.04 * F.hypot(width, height))


def angular_error(a: list[Column], b: list[Column]) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.degrees(F.acos(F.least(dot(a, b) / norms, F.lit(0.9999999))))


def angle_bin(degrees: Column, low: float = -180.0, width: float = 4.0) -> Column:
    return F.floor((degrees - low) / width).cast("int")


def plain_attention(pitch: Column, yaw: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.abs(pitch), F.abs(yaw)))


def signed_scalar(direction: Column, magnitude: Column) -> Column:
    return F.when(direction == "negative", -magnitude).when(direction == "neutral", 0.0).otherwise(magnitude)


def peak_dbfs(peak: Column) -> Column:
    return 20 * F.log10(F.abs(peak) + 1e-6)
