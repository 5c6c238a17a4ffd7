"""Series operators on events: a user stands for a person, an event for a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import r
from ..functions.text import folded_emotion
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import series as S
from ..plans import layers as L
from .base import TRACE, query, rounded, table, trace

#: Fixed values of the stand-in: which emotion each event type stands for.
EMOTIONS = {"purchase": "happiness", "error": "anger", "signup": "surprise", "view": "neutral"}


def emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = F.col("event_type")
    for kind, name in EMOTIONS.items():
        mapping = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(mapping)
    x = trace(spark, sf_dir).withColumn("emotion", folded_emotion(mapping))
    return x.withColumn("magnitude", r(F.col("score"), 2))


EMOTION = f"""{TRACE}, emo AS (
  SELECT user_id, t, {rounded("score", 2)} AS magnitude,
    CASE event_type WHEN 'purchase' THEN 'joy' WHEN 'error' THEN 'anger' WHEN 'signup' THEN 'surprise' WHEN 'view' THEN 'neutral' ELSE event_type END AS emotion
  FROM trace
), flagged AS (
  SELECT *, CASE WHEN lag(emotion) OVER w IS NULL OR lag(emotion) OVER w = emotion THEN 0 ELSE 1 END AS c FROM emo WINDOW w AS (PARTITION BY user_id ORDER BY t)
), numbered AS (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS run FROM flagged
), per_run AS (
  SELECT user_id, run, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_max(magnitude, t) AS mag, min(emotion) AS now FROM numbered GROUP BY user_id, run
), chained AS (
  SELECT *, lag(t1) OVER w AS tb, lag(now) OVER w AS wb FROM per_run WINDOW w AS (PARTITION BY user_id ORDER BY run)
), slices AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY run) AS slice_id, coalesce(tb, t0) AS slice_start, t1 AS slice_end, coalesce(wb, now) AS from_state, now AS to_state,
    {rounded("mag", 2)} AS terminal_magnitude,
    CASE WHEN now IN ('joy', 'amusement', 'relief') THEN 'positive' WHEN now IN ('anger', 'disgust', 'fear', 'sadness') THEN 'negative' ELSE 'neutral' END AS direction, mag
  FROM chained WHERE run > 0 OR n >= 2
), signed AS (
  SELECT user_id, slice_id, slice_start, slice_end, from_state, to_state, terminal_magnitude, direction,
    CASE direction WHEN 'negative' THEN -{rounded("mag", 2)} WHEN 'neutral' THEN 0.0 ELSE {rounded("mag", 2)} END AS scalar FROM slices
)"""


@query(f"WITH {EMOTION} SELECT user_id, CAST(slice_id AS INTEGER) AS slice_id, slice_start, slice_end, from_state, to_state, terminal_magnitude, direction, scalar + 0.0 AS scalar FROM signed")
def emotion_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.state_slices(emotions(spark, sf_dir), ["user_id"], "t", "emotion", "magnitude").withColumn("scalar", F.col("scalar") + 0.0)


@query(
    f"""WITH {EMOTION} SELECT user_id, CAST(slice_id AS INTEGER) AS slice_id,
  string_agg(slice_id || '. ' || from_state || ' -> ' || to_state || ' (Classified: ' || direction || ')', chr(10)) OVER (PARTITION BY user_id ORDER BY slice_id ROWS UNBOUNDED PRECEDING) AS history FROM signed"""
)
def emotion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(emotion_slices(spark, sf_dir), ["user_id"]).select("user_id", "slice_id", "history")


PERSON_SCORES = f"""{EMOTION}, first_t AS (SELECT user_id, min(t) AS climax FROM trace GROUP BY user_id), weighed AS (
  SELECT s.user_id, scalar, (slice_end - slice_start) * greatest(0.1, slice_start - climax) AS w FROM signed s JOIN first_t USING (user_id)
), person AS (
  SELECT user_id, CASE WHEN sum(w) > 0 THEN {rounded("(sum(scalar * w) / sum(w))", 2)} ELSE 0.0 END + 0.0 AS late_stage_score FROM weighed GROUP BY user_id
)"""


@query(f"WITH {PERSON_SCORES} SELECT user_id, late_stage_score FROM person")
def late_stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = trace(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("climax"))
    slices = emotion_slices(spark, sf_dir).join(first, "user_id")
    return S.late_stage_score(slices, ["user_id"], F.col("climax")).select("user_id", (F.col("late_stage_score") + 0.0).alias("late_stage_score"))


ATTENTION = f"""{TRACE}, marked AS (
  SELECT *, CASE WHEN lag(score >= 0.7) OVER w IS NULL OR lag(score >= 0.7) OVER w = (score >= 0.7) THEN 0 ELSE 1 END AS c FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY t)
), islands AS (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t) AS run FROM marked
), spans AS (
  SELECT user_id, run, CASE WHEN bool_and(score >= 0.7) THEN max(t) - min(t) ELSE 0.0 END AS span FROM islands GROUP BY user_id, run
), held AS (
  SELECT user_id, max(span) AS sustained FROM spans GROUP BY user_id
), kinds AS (
  SELECT user_id, event_type, count(*) AS n, min(t) AS first_t FROM trace WHERE event_type <> 'error' GROUP BY user_id, event_type
), best AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_t) AS k FROM kinds
), peak AS (
  SELECT user_id, t AS peak_t, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t) AS k FROM trace
), stats AS (
  SELECT user_id, avg(score) AS m, coalesce(var_samp(score), 0.0) AS v FROM trace GROUP BY user_id
), persons AS (
  SELECT s.user_id AS person_id, s.user_id % 10 AS video_id, {rounded("m", 2)} AS average_attention_score, peak_t AS peak_engagement_timestamp_sec, {rounded("v", 4)} AS attention_variance,
    {rounded("sustained", 2)} AS sustained_engagement_sec, (m >= 0.5 OR sustained > 2.0) AS is_engaged, coalesce(b.event_type, 'error') AS gaze_target_classification
  FROM stats s JOIN held USING (user_id) JOIN peak p ON p.user_id = s.user_id AND p.k = 1 LEFT JOIN best b ON b.user_id = s.user_id AND b.k = 1
)"""


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).select(F.col("user_id").alias("person_id"), (F.col("user_id") % 10).alias("video_id"), "t", "score", F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("event_type")).alias("target"))
    out = L.attention_summary(x)
    kind = F.col("gaze_target_classification")
    return out.withColumn("gaze_target_classification", F.when(kind == "Unknown", "error").otherwise(kind))


@query(f"WITH {ATTENTION} SELECT * FROM persons")
def attention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _persons(spark, sf_dir)


@query(
    f"""WITH {ATTENTION} SELECT video_id, count(*) AS num_bystanders_tracked, {rounded("avg(average_attention_score)", 2)} AS mean_attention_all_persons,
  bool_or(is_engaged) AS any_person_engaged FROM persons GROUP BY video_id"""
)
def attention_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.attention_aggregate(_persons(spark, sf_dir))


@query(f"WITH {ATTENTION} SELECT user_id, {rounded('sustained', 4)} AS sustained FROM held")
def sustained_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sustained(trace(spark, sf_dir), ["user_id"], "t", F.col("score") >= 0.7).withColumn("sustained", r(F.col("sustained"), 4))


@query(f"WITH {TRACE} SELECT user_id, {rounded('avg(score)', 3)} AS mean_score, {rounded('var_pop(score)', 3)} AS variance, avg(score) > 0.6 AS engaged FROM trace GROUP BY user_id")
def plain_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).select(F.col("user_id").alias("person_id"), F.lit(0).alias("video_id"), "score")
    return L.plain_attention_summary(x).drop("video_id").withColumnRenamed("person_id", "user_id")


@query(
    f"""WITH {PERSON_SCORES}, weights AS (SELECT user_id, {rounded("avg(score)", 2)} AS weight FROM trace WHERE event_type = 'signup' GROUP BY user_id)
SELECT p.user_id % 10 AS task_id, CASE WHEN sum(coalesce(weight, 1.0)) > 0 THEN {rounded("(sum(late_stage_score * coalesce(weight, 1.0)) / sum(coalesce(weight, 1.0)))", 2)} ELSE 0.0 END + 0.0 AS task_aggregate_score
FROM person p LEFT JOIN weights USING (user_id) GROUP BY 1"""
)
def attention_weighted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = trace(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id").agg(r(F.avg("score"), 2).alias("average_attention_score"))
    persons = late_stage_scores(spark, sf_dir).withColumn("task_id", F.col("user_id") % 10)
    out = L.task_scores(persons, ["task_id"], weights, ["user_id"])
    return out.select("task_id", (F.col("task_aggregate_score") + 0.0).alias("task_aggregate_score"))


@query(
    f"""WITH {TRACE}, gaps AS (SELECT user_id, event_id, t, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM trace), n AS (
  SELECT *, row_number() OVER w AS i FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY t)
), k AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(v IGNORE NULLS) OVER b AS va,
    first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib, first_value(v IGNORE NULLS) OVER f AS vb FROM n
  WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT user_id, event_id, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS filled, CASE WHEN v IS NOT NULL THEN v WHEN va IS NOT NULL AND vb IS NOT NULL THEN va + (vb - va) * (i - ia) / (ib - ia) ELSE coalesce(va, vb, 0.0) END AS x FROM k
) SELECT user_id, event_id, filled, {rounded("x", 4)} AS value FROM filled"""
)
def interpolated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).select("user_id", "event_id", "t", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"))
    return S.nan_interpolated(x, ["user_id"], "t", "value").select("user_id", "event_id", "filled", r(F.col("value"), 4).alias("value"))


@query(
    f"""WITH {TRACE}, m AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS centred,
  coalesce(lag(value) OVER w, 0.0) AS a, value AS b, coalesce(lead(value) OVER w, 0.0) AS c FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, event_id, {rounded("centred", 4)} AS centred, greatest(least(a, b), least(greatest(a, b), c)) AS median FROM m"""
)
def smoothed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).withColumn("centred", F.col("value")).withColumn("median", F.col("value"))
    x = S.median3(S.detrended(x, ["user_id"], "centred"), ["user_id"], "t", "median")
    return x.select("user_id", "event_id", r(F.col("centred"), 4).alias("centred"), "median")


@query(f"WITH {TRACE}, m AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM trace) SELECT user_id, event_id, value FROM m WHERE top >= 3.0 AND value > 0.7 * top")
def motion_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spikes(trace(spark, sf_dir), ["user_id"], "value").select("user_id", "event_id", "value")


@query(
    f"""WITH {TRACE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k FROM trace), rough AS (
  SELECT user_id, t AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) AS r FROM i WHERE k % 6 = 0
), dense AS (
  SELECT i.user_id, t, value, row_number() OVER (PARTITION BY i.user_id ORDER BY value DESC, t) AS r FROM i JOIN rough ON rough.user_id = i.user_id AND rough.r = 1 WHERE abs(t - c) <= 86400
) SELECT user_id, t AS climax, value AS peak FROM dense WHERE r = 1"""
)
def climax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.climax(trace(spark, sf_dir), ["user_id"], "t", "value", half=86400.0)


@query(
    f"""WITH {TRACE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) AS k FROM trace)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) AS INTEGER) AS position FROM r WHERE k <= 3"""
)
def top_three_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_by_time(trace(spark, sf_dir), ["user_id"], "t", "value").select("user_id", "event_id", "position")


@query(
    f"""WITH {TRACE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  greatest(5, least(20, CAST(trunc((max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id)) / 86400 * 3) AS INTEGER))) AS k FROM trace)
SELECT user_id, event_id FROM i WHERE n <= k OR i = n - 1 OR list_contains(list_transform(range(k - 1), lambda j: CAST(trunc(j * ((n - 1) / (k - 1))) AS BIGINT)), i)"""
)
def evenly_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evenly_picked(trace(spark, sf_dir), ["user_id"], "t", per_second=3 / 86400).select("user_id", "event_id")


@query(
    f"""WITH {TRACE}, windows AS (SELECT user_id, min(t) AS s, max(t) AS e FROM trace GROUP BY user_id)
SELECT user_id, bool_or(t BETWEEN e - 0.25 * (e - s) AND e AND value / 100 BETWEEN 0.35 AND 0.65 AND score BETWEEN 0.35 AND 0.65) AS centred FROM trace JOIN windows USING (user_id) GROUP BY user_id"""
)
def tail_centring(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir)
    windows = x.groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    return S.tail_centred(x.join(windows, "user_id"), ["user_id"], "t", "s", "e", F.col("value") / 100, F.col("score"))


@query(
    f"""WITH {TRACE}, p AS (SELECT user_id, floor(t / 86400) AS d, event_type, avg(value) AS x, max(value) AS y FROM trace GROUP BY ALL), n AS (
  SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY d) AS k FROM p
), j AS (SELECT a.user_id, a.d, a.d - b.d AS gap, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM n a JOIN n b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.k = b.k + 1)
SELECT user_id, d, {rounded("(avg(dist) / min(gap))", 4)} AS velocity FROM j WHERE gap > 0 AND gap <= 3 GROUP BY user_id, d"""
)
def keypoint_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 86400).cast("double").alias("d"), "event_type").agg(F.avg("value").alias("x"), F.max("value").alias("y"))
    return S.velocities(x, ["user_id"], "d", "event_type", "x", "y", most_gap=3.0).withColumn("velocity", r(F.col("velocity"), 4))


@query(
    f"""WITH {TRACE}, x AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) AS k FROM trace WHERE value > 0)
SELECT user_id, value AS peak, t AS peak_t FROM x WHERE k = 1"""
)
def velocity_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.velocity_peak(trace(spark, sf_dir), ["user_id"], "t", "value")


@query(
    f"""WITH {TRACE}, x AS (SELECT user_id, list(event_id ORDER BY t) AS e, list(value ORDER BY t) AS v FROM trace GROUP BY user_id)
SELECT user_id, len(e) AS n, array_to_string(e, ',') AS events, array_to_string(list_transform(v, lambda a: CAST(CAST(round(a * 100) AS BIGINT) AS VARCHAR)), ',') AS hundredths FROM x"""
)
def person_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.tracks(trace(spark, sf_dir), ["user_id"], "t", ["event_id"], "value")
    ids = F.transform("bounding_boxes", lambda b: b[0].cast("string"))
    return x.select("user_id", F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("events"), F.array_join(F.transform("detection_confidence", lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("hundredths"))


@query(
    f"""WITH RECURSIVE {TRACE}, n AS (SELECT user_id, event_id, t / 86400 AS t, score, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM trace), walked AS (
  SELECT user_id, event_id, t, score, i, true AS taken, false AS in_burst, t + 1.0 AS due, -1e300::DOUBLE AS until, score AS last FROM n WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, t, score, i, taken, taken AND t <= until AS in_burst, CASE WHEN taken THEN t + CASE WHEN t < until THEN 0.5 ELSE 1.0 END ELSE due END AS due, until, CASE WHEN taken THEN score ELSE last END AS last FROM (
    SELECT n.user_id, n.event_id, n.t, n.score, n.i, n.t + 1e-9 >= w.due AS taken, CASE WHEN n.t + 1e-9 >= w.due AND abs(n.score - w.last) > 0.3 THEN n.t + 2.0 ELSE w.until END AS until, w.due, w.last
    FROM walked w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
) SELECT user_id, event_id, t, score, in_burst FROM walked WHERE taken"""
)
def burst_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stand for eighths of a second."""
    x = trace(spark, sf_dir).select("user_id", "event_id", (F.col("t") / 86400).alias("t"), "score")
    return S.burst_sampled(x, ["user_id"], "t", "score", base=1.0, burst=0.5, jump=0.3, hold=2.0)


@query()
def head_oscillations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles from the values; days of a user stand for seconds."""
    x = trace(spark, sf_dir).select("user_id", (F.col("t") / 86400).alias("t"), (F.col("score") - 0.5).alias("pitch"), F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value") / 1000).alias("yaw"))
    return S.oscillations(x, ["user_id"], "t", "pitch", "yaw")


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("t"), "o_totalprice")


ORDERS = "o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1e6 / 86400 AS t, o_totalprice FROM orders)"


@query(
    f"""WITH {ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, o_orderkey DESC) AS z FROM o),
x AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN a = 1 THEN o_totalprice END) AS f, max(CASE WHEN z = 1 THEN o_totalprice END) AS l, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN regr_slope(o_totalprice, t) * (max(t) - min(t)) END AS d FROM n GROUP BY o_custkey)
SELECT o_custkey, {rounded("(CASE WHEN n >= 2 THEN CASE WHEN f > 0 THEN (l - f) / f * 100 ELSE 0.0 END END)", 4)} AS area_delta_pct, {rounded("d", 2)} AS depth_delta FROM x"""
)
def area_and_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders_series(spark, sf_dir).withColumn("at", F.struct("t", "o_orderkey"))
    area = A.area_delta(x, ["o_custkey"], "at", F.col("o_totalprice"))
    slope = A.slope_span(x, ["o_custkey"], "t", "o_totalprice")
    return area.join(slope, "o_custkey").select("o_custkey", r(F.col("area_delta_pct"), 4).alias("area_delta_pct"), r(F.col("delta"), 2).alias("depth_delta"))


@query(
    f"""WITH {TRACE} SELECT user_id, {rounded("quantile_cont(value, 0.95)", 4)} AS p95, {rounded("sum(-value)", 2)} AS shift_x, {rounded("sum(-score)", 2)} AS shift_y,
  {rounded("(CASE WHEN count(value) > 1 THEN least(1.0, var_pop(value) / 10000) ELSE 0.0 END)", 4)} AS variance, {rounded("(20 * log10(max(abs(value)) + 1e-6))", 4)} AS dbfs, {rounded("least(1.0, max(value) / 20)", 4)} AS chaos FROM trace GROUP BY user_id"""
)
def signal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir)
    from ..functions.maths import normalised, peak_dbfs

    high = A.percentiles(x, ["user_id"], "value", [0.95], ["p95"], few=40).withColumn("p95", r(F.col("p95"), 4))
    stats = x.groupBy("user_id").agg(r(peak_dbfs(F.max(F.abs("value"))), 4).alias("dbfs"), r(normalised(F.max("value"), 20.0), 4).alias("chaos"))
    shift = A.camera_shift(x, ["user_id"], "value", "score")
    var = A.normalised_variance(x, ["user_id"], "value").withColumn("variance", r(F.col("variance"), 4))
    return stats.join(high, "user_id").join(shift, "user_id").join(var, "user_id")


@query(
    f"""WITH x AS (SELECT l_orderkey, l_returnflag, l_partkey % 5 AS k, l_quantity AS x, l_discount AS y FROM lineitem), m AS (
  SELECT l_orderkey, l_returnflag, avg(x) FILTER (WHERE k IN (0, 1)) AS sx, avg(y) FILTER (WHERE k IN (0, 1)) AS sy, avg(x) FILTER (WHERE k IN (2, 3)) AS hx, avg(y) FILTER (WHERE k IN (2, 3)) AS hy FROM x GROUP BY 1, 2
) SELECT l_orderkey, l_returnflag, {rounded("atan2(sy - hy, sx - hx)", 4)} AS angle FROM m WHERE sx IS NOT NULL AND hx IS NOT NULL"""
)
def body_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with one flag stand for the keypoints of a sample: shoulders, hips and a nose."""
    point = F.element_at(F.array(*map(F.lit, (5, 6, 11, 12, 0))), (F.col("l_partkey") % 5 + 1).cast("int"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", point.alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return A.spine_angles(x, ["l_orderkey"], "l_returnflag", "k", "x", "y").withColumn("angle", r(F.col("angle"), 4))


@query(f"""SELECT l_orderkey, {rounded("coalesce(median(l_quantity) FILTER (WHERE l_returnflag = 'R'), median(l_quantity)) / 255", 6)} AS depth FROM lineitem GROUP BY l_orderkey""")
def masked_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines stand for the pixels under the mask of a sample."""
    x = A.masked_median(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", F.col("l_returnflag") == "R")
    return x.select("l_orderkey", r(F.col("median"), 6).alias("depth"))


def _ray(x1: str, y1: str, x2: str, y2: str) -> str:
    x, y, z = f"-(({x1} + {x2}) / 2 - 320.0)", f"-(({y1} + {y2}) / 2 - 240.0)", "-640.0"
    return f"((-cos(yaw) * sin(pitch)) * ({x}) + (-sin(yaw)) * ({y}) + (-cos(yaw) * cos(pitch)) * ({z})) / sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"


def _closest(kind: str, columns: str) -> str:
    return f"""SELECT g.event_id, {columns}, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(b.t - g.t), b.t) AS k FROM g JOIN trace b ON b.user_id = g.user_id AND b.event_type = '{kind}' AND abs(b.t - g.t) <= 400000"""


@query(
    f"""WITH {TRACE}, g AS (SELECT user_id, event_id, t, score - 0.5 AS pitch, value / 100 - 0.5 AS yaw FROM trace WHERE event_type = 'purchase'), box AS ({_closest("view", "b.value * 6 AS x, b.score * 400 AS y")}), hand AS ({_closest("signup", "b.value * 6 AS hx, b.score * 480 AS hy, b.value")}), d AS (
  SELECT user_id, g.t, {_ray("x", "y", "x + 20", "y + 40")} AS person, CASE WHEN h.value > 5 THEN greatest({_ray("hx", "hy", "hx + 30", "hy + 30")}, {_ray("(640 - hx)", "hy", "(640 - hx)", "(hy + 10)")}) END AS hand
  FROM g JOIN box b ON b.event_id = g.event_id AND b.k = 1 LEFT JOIN hand h ON h.event_id = g.event_id AND h.k = 1
) SELECT user_id, {rounded("t", 2)} AS t, CASE WHEN hand > person THEN 'POV_Actor_Hands' ELSE 'Camera' END AS target, {rounded("greatest(0.0, least(1.0, (greatest(person, coalesce(hand, person)) - 0.5) * 2))", 2)} AS score FROM d"""
)
def gaze_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for gaze samples, views for boxes, signups for frames with two hands, or none if their value is small."""
    x = trace(spark, sf_dir).withColumns({"video_id": F.col("user_id"), "person_id": F.lit(0)})
    gaze = x.where("event_type = 'purchase'").select("video_id", "person_id", "t", (F.col("score") - 0.5).alias("pitch_rad"), (F.col("value") / 100 - 0.5).alias("yaw_rad"))
    left, top = F.col("value") * 6, F.col("score") * 400
    boxes = x.where("event_type = 'view'").select("video_id", "person_id", "t", left.alias("x1"), top.alias("y1"), (left + 20).alias("x2"), (top + 40).alias("y2"))
    low = F.col("score") * 480
    two = F.array(F.array(left, low, left + 30, low + 30), F.array(640 - left, low, 640 - left, low + 10))
    hands = x.where("event_type = 'signup'").select("video_id", "t", F.when(F.col("value") > 5, two).otherwise(F.array().cast("array<array<double>>")).alias("hand_boxes"))
    camera = x.select("video_id", F.lit(640).alias("width"), F.lit(480).alias("height"), *(F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "focal"))).distinct()
    out = L.attention(gaze, boxes, camera, 400_000.0, hands)
    return out.select(F.col("video_id").alias("user_id"), "t", "target", "score")


_B, _A = S.band_pass(0.125, 0.375)
_STEADY = S.recursion(_B, _A)[2]


def _pass(name: str, source: str) -> str:
    """SQL of one filter pass over source (user_id, i, x), from its steady state."""
    x, out = "e.x", f"({float(_B[0])!r} * e.x + f.s1)"
    start = [f"({float(s)!r} * e.x)" for s in _STEADY]
    first = f"({float(_B[0])!r} * e.x + {start[0]})"

    def after(states: list[str], y: str) -> str:
        return ", ".join(f"{states[k] if k < 4 else '0.0'} + {float(_B[k])!r} * {x} - {float(_A[k])!r} * {y}" for k in range(1, 5))

    return f"""{name}(user_id, i, y, s1, s2, s3, s4) AS (
  SELECT e.user_id, e.i, {first}, {after(start, first)} FROM {source} e WHERE e.i = 0
  UNION ALL SELECT e.user_id, e.i, {out}, {after([f"f.s{k}" for k in range(1, 5)], out)} FROM {name} f JOIN {source} e ON e.user_id = f.user_id AND e.i = f.i + 1
)"""


@query(
    f"""WITH RECURSIVE {TRACE}, n AS (
  SELECT user_id, event_id, value AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS head, last_value(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail
  FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY t)
), ext AS (
  SELECT user_id, n, i + 15 AS i, v AS x FROM n WHERE n > 15 UNION ALL SELECT user_id, n, 15 - i, 2 * head - v FROM n WHERE n > 15 AND i BETWEEN 1 AND 15
  UNION ALL SELECT user_id, n, 15 + n - 1 + (n - 1 - i), 2 * tail - v FROM n WHERE n > 15 AND n - 1 - i BETWEEN 1 AND 15
), {_pass("fwd", "ext")}, rev AS (SELECT user_id, max(i) OVER (PARTITION BY user_id) - i AS i, y AS x FROM fwd), {_pass("bwd", "rev")}
SELECT n.user_id, event_id, {rounded("y", 6)} + 0.0 AS value FROM n JOIN bwd ON bwd.user_id = n.user_id AND bwd.i = n.n + 29 - (n.i + 15)"""
)
def zero_phase_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir).select("user_id", "event_id", "t", "value")
    out = S.zero_phase_series(x, ["user_id"], "t", "value", _B, _A, block_rows=32)
    return out.select("user_id", "event_id", (r(F.col("value"), 6) + 0.0).alias("value"))
