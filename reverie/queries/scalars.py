"""Text rules, filters and scores on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import maths as M
from ..functions import text as T
from ..operators import filters as L
from ..operators.ranks import ranked
from ..operators.series import fixed_steps, strided
from .base import TRACE, query, rounded, table, trace

FAST, SLOW = "|".join(C.FAST_WORDS), "|".join(C.SLOW_WORDS)


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{FAST}') THEN 'fast' WHEN regexp_matches(lower(text), '{SLOW}') THEN 'slow' ELSE 'medium' END AS velocity FROM documents"""
)
def velocity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.velocity_class(F.col("text")).alias("velocity"))


@query(
    """SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, string_split(p_brand, '#')[1] AS head, list_last(string_split(p_type, ' ')) AS tail, printf('t_%02d', p_size) AS task_id, regexp_matches(upper(trim(p_type)), '^(STANDARD|PROMO)') AS says_yes,
  CAST(nullif(regexp_extract(p_brand, '[1-3]'), '') AS INTEGER) AS choice FROM part"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    yes = T.says_yes(F.regexp_replace("p_type", "(?i)^(STANDARD|PROMO)", "YES"))
    return p.select(
        "p_partkey", T.collapsed(F.col("p_name")).alias("name"), T.before_dot(F.regexp_replace("p_brand", "#", ".")).alias("head"), T.after_slash(F.regexp_replace("p_type", " ", "/")).alias("tail"),
        T.task_id(F.col("p_size")).alias("task_id"), yes.alias("says_yes"), T.first_choice(F.col("p_brand")).alias("choice"),
    )


@query(
    """SELECT page_id, regexp_matches(html, '^data:image/[a-z]+;base64,') OR regexp_matches(html, '^/[Vv]olumes/|^/Users/|^/tmp/') OR regexp_matches(url, '^/[Vv]olumes/|^/Users/|^/tmp/') AS leaks, regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1') AS stem FROM pages"""
)
def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", (T.leaks(F.col("html")) | T.leaks(F.col("url"))).alias("leaks"), T.stem(F.col("url")).alias("stem"))


@query(
    """SELECT conv_id, string_agg(coalesce(role, 'Unknown'), ', ' ORDER BY turn) AS labels, count(*) AS n, bool_and(contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'reading books') OR contains(lower(text), 'sleeping')) AS solo FROM conversations GROUP BY conv_id"""
)
def conversation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return c.select("conv_id", T.joined_labels(F.col("x.role")).alias("labels"), F.size("x").cast("long").alias("n"), L.likely_solo(F.col("x.text")).alias("solo"))


@query(
    f"""WITH t AS (SELECT conv_id, list_filter(list_transform(list(role ORDER BY turn), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('idling', 'no clear task', 'ambiguous activity')) AS l, CAST(sum(len(text)) AS DOUBLE) AS d FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, d, len(l) AS n, unnest(range(len(l))) AS i, unnest(l) AS task_label FROM t)
SELECT conv_id, printf('t_%02d', i) AS task_id, task_label, {rounded("(i * (d / n))", 2)} AS task_start_sec, {rounded("((i + 1) * (d / n))", 2)} AS task_end_sec FROM u"""
)
def task_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.layers import tasks_of

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.sum(F.length("text")).cast("double").alias("duration_sec"))
    out = tasks_of(c.select(F.col("conv_id").alias("video_id"), F.col("x.role").alias("labels"), "duration_sec"), "labels")
    return out.select(F.col("video_id").alias("conv_id"), "task_id", "task_label", "task_start_sec", "task_end_sec")


def _window(at: dict[str, float]) -> str:
    """SQL of one end of the reaction window, clamped to 60 seconds."""
    return f"least(60.0, CASE event_type WHEN 'purchase' THEN {rounded(f'(value + {at["fast"]})', 2)} WHEN 'error' THEN {rounded(f'(value + {at["slow"]})', 2)} ELSE {rounded(f'(value + {at["medium"]})', 2)} END)"


@query(f"WITH {TRACE} SELECT event_id, {_window({k: v[0] for k, v in C.REACTION_WINDOWS.items()})} AS win_start, {_window({k: v[1] for k, v in C.REACTION_WINDOWS.items()})} AS win_end FROM trace")
def reaction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of the windows, of recordings of a minute, so that many are clamped."""
    velocity = F.when(F.col("event_type") == "purchase", "fast").when(F.col("event_type") == "error", "slow").otherwise("medium")
    start, end = M.reaction_window(F.col("value"), velocity, F.lit(60.0))
    return trace(spark, sf_dir).select("event_id", start.alias("win_start"), end.alias("win_end"))


VECTOR = "v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_quantity - 25 AS area, l_tax - l_discount AS depth FROM lineitem)"


@query(
    f"""WITH {VECTOR}, x AS (SELECT *, 0.4 * greatest(-1.0, least(1.0, area / 50)) + 0.6 * greatest(-1.0, least(1.0, -2 * depth)) AS raw FROM v), y AS (SELECT *, CASE WHEN abs(raw) < 0.05 THEN 0.0 ELSE {rounded("raw", 2)} END AS vector FROM x)
SELECT CASE WHEN vector > 0.3 THEN 'Approach_Intervention' WHEN vector < -0.3 THEN 'Avoidance' ELSE 'Neutral' END AS action, count(*) AS n, {rounded("sum(vector)", 2)} AS total, {rounded("sum(1 - abs(sign(area) - sign(-depth)) / 2)", 2)} AS confidence FROM y GROUP BY 1"""
)
def proxemic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, depth = F.col("l_quantity") - 25, F.col("l_tax") - F.col("l_discount")
    vector = M.proxemic_vector(area, depth)
    x = table(spark, sf_dir, "lineitem").select(M.proxemic_action(vector).alias("action"), vector.alias("vector"), M.proxemic_confidence(area, depth).alias("c"))
    return x.groupBy("action").agg(F.count("*").alias("n"), M.r(F.sum("vector"), 2).alias("total"), M.r(F.sum("c"), 2).alias("confidence"))


@query(
    f"""WITH s AS (SELECT vec_id, list_transform(embedding[1:9], lambda x: abs(CAST(x AS DOUBLE))) AS e, abs(embedding[10]) AS p, -60 * abs(CAST(embedding[11] AS DOUBLE)) AS dbfs FROM embeddings), t AS (
  SELECT vec_id, e[1] + e[5] + CASE WHEN dbfs > -20 THEN 0.3 ELSE 0.0 END AS a, e[2] + e[4] + CAST(p AS DOUBLE) * 0.5 AS b, e[3] + CASE WHEN dbfs < -35 THEN 0.3 ELSE 0.0 END AS c, e[6] AS d FROM s
), u AS (SELECT *, greatest(a, b, c, d) AS m FROM t)
SELECT vec_id, CASE WHEN m < 0.3 THEN 'Neutral' WHEN a = m THEN 'Alarming' WHEN b = m THEN 'Soothing' WHEN c = m THEN 'Discouraging' ELSE 'Neutral' END AS tone,
  CASE WHEN m < 0.3 THEN 0.0 WHEN a = m THEN -1.0 WHEN b = m THEN 1.0 WHEN c = m THEN -0.5 ELSE 0.0 END AS scalar FROM u"""
)
def acoustic_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    values = F.transform(F.slice("embedding", 1, 9), lambda x: F.abs(x.cast("double")))
    scores = F.map_from_arrays(F.array(*map(F.lit, C.VOICE_LABELS)), values)
    tone = M.tone(scores, -60 * F.abs(F.get("embedding", F.lit(10)).cast("double")), F.abs(F.get("embedding", F.lit(9))).cast("double"))
    return e.select("vec_id", tone.alias("t")).select("vec_id", F.col("t.tone").alias("tone"), F.col("t.scalar").cast("double").alias("scalar"))


@query(
    f"""WITH g AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, CAST(embedding[5] AS DOUBLE) AS c FROM embeddings), d AS (
  SELECT vec_id, p, y, (-cos(y) * sin(p) * a - sin(y) * b - cos(y) * cos(p) * c) / sqrt(a * a + b * b + c * c) AS dot FROM g
) SELECT vec_id, {rounded("greatest(0.0, least(1.0, (dot - 0.5) * 2))", 2)} AS score, {rounded("greatest(0.0, 1 - greatest(abs(p), abs(y)))", 4)} AS plain, {rounded("degrees(acos(least(dot, 0.9999999)))", 2)} AS error,
  CAST(floor((degrees(p) + 180) / 4) AS INTEGER) AS bin FROM d"""
)
def gaze_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.get("embedding", F.lit(i)).cast("double") for i in range(5)]
    ray, box = M.gaze_ray(x[0], x[1]), M.unit(x[2:])
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", M.attention_score(M.dot(ray, box)).alias("score"), M.r(M.plain_attention(x[0], x[1]), 4).alias("plain"), M.r(M.angular_error(ray, x[2:]), 2).alias("error"), M.angle_bin(F.degrees(x[0])).alias("bin")
    )


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS w FROM embeddings) SELECT vec_id, {rounded("radians(list_inner_product(w, list_transform(range(len(w)), lambda i: CAST(i AS DOUBLE))) / list_sum(w) * 4 - 180)", 4)} AS angle FROM e"""
)
def expected_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", M.r(M.softmax_angle(F.transform("embedding", lambda x: x.cast("double"))), 4).alias("angle"))


@query(
    f"""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 17 AS DOUBLE) AS o FROM part), i AS (
  SELECT p_partkey, greatest(0.0, least(s, o + 20) - greatest(0.0, o)) * greatest(0.0, least(s, 30.0) - greatest(0.0, o)) AS x, s * s + 20 * (30 - o) AS u FROM b
) SELECT p_partkey, {rounded("(CASE WHEN u - x > 0 THEN x / (u - x) ELSE 0.0 END)", 4)} AS iou FROM i"""
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o, zero = F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"), F.lit(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", M.r(M.iou([zero, zero, s, s], [o, o, o + 20, F.lit(30.0)]), 4).alias("iou"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT ((l_quantity > 0.95 * 50 AND l_linenumber > 0.15 * 50) OR (l_linenumber = 1 AND l_quantity > 0.9 * 50) ) AND l_returnflag <> 'R'
  AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_shipdate) >= 2)"""
)
def detection_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    steady = L.consistent(x, "l_orderkey", "l_shipdate")
    own = L.wearer_artifact(F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber")), F.col("l_quantity"), F.lit(50.0))
    return steady.where(~own & (F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    f"""WITH {TRACE}, f AS (SELECT user_id, event_type, value, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM trace)
SELECT user_id, CAST(count(*) FILTER (WHERE k <= 5 AND event_type = 'purchase') AS BIGINT) AS yes, count(*) FILTER (WHERE k <= 5 AND event_type = 'purchase') >= 2 AS confirmed, max(CASE WHEN k = 1 THEN event_type END) AS verdict FROM f GROUP BY user_id HAVING count(*) >= 5"""
)
def confirmation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.enough_points(trace(spark, sf_dir), ["user_id"], 5)
    first = L.first_verdict(x, "user_id", "t", "event_type").withColumnRenamed("event_type", "verdict")
    return L.confirmed(x, "user_id", "t", F.col("event_type") == "purchase").join(first, "user_id")


@query(
    """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, len(list_filter(e[1:5], lambda x: x >= 0.3)) > 0 AND len(list_filter(e[6:7], lambda x: x >= 0.3)) > 0 AS visible, CAST(CASE vec_id % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.25 ELSE 0.3 END AS DOUBLE) AS threshold FROM d"""
)
def keypoint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("vec_id") % 4 == 0, "crossgaze").when(F.col("vec_id") % 4 == 1, "3dgazenet").otherwise("none")
    conf = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", L.head_and_shoulder(conf).alias("visible"), L.gaze_threshold(model).alias("threshold"))


@query("SELECT n_nationkey, lower(trim(n_name)) IN ('france', 'germany', 'nation_1') AS supported, CAST(count(s_suppkey) AS BIGINT) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def supported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    out = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n"))
    return out.select("n_nationkey", L.supported(F.col("n_name"), ("france", "germany", "nation_1")).alias("supported"), "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'signup' THEN 'joy' WHEN 'error' THEN 'disgust' WHEN 'view' THEN 'neutral' ELSE event_type END AS emotion FROM events")
def json_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Happiness").when(F.col("event_type") == "error", "contempt").when(F.col("event_type") == "view", "unknown").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), T.folded_emotion(kind).alias("emotion"))


@query(
    f"""SELECT p_partkey, len(g) AS n_steps, {rounded("list_sum(g)", 4)} AS total, {rounded("g[-1]", 4)} AS last, (p_partkey % greatest(1, CAST(trunc(30.0 / 10) AS INTEGER))) = 0 AS sampled
FROM (SELECT p_partkey, list_transform(range(CAST(floor(p_size / 0.33 + 1e-9) AS BIGINT) + 1), lambda i: CAST(p_partkey % 7 + i * 0.33::DOUBLE AS DOUBLE)) AS g FROM part)"""
)
def sampling_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_partkey") % 7).cast("double")
    steps = fixed_steps(start, start + F.col("p_size"), 0.33)
    total = F.aggregate("g", F.lit(0.0), lambda s, x: s + x)
    x = table(spark, sf_dir, "part").select("p_partkey", steps.alias("g"), strided(F.col("p_partkey"), F.lit(30.0), 10.0).alias("sampled"))
    return x.select("p_partkey", F.size("g").cast("long").alias("n_steps"), M.r(total, 4).alias("total"), M.r(F.element_at("g", -1), 4).alias("last"), "sampled")


@query("SELECT c_custkey, row_number() OVER (ORDER BY regexp_extract(c_name, '^\\D*') NULLS LAST, CAST(nullif(regexp_extract(c_name, '\\d+'), '') AS BIGINT), c_custkey) AS place FROM customer")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the order of the natural key, nulls last."""
    c = table(spark, sf_dir, "customer").select("c_custkey", T.natural_key(F.col("c_name")).alias("key"))
    return ranked(c, [F.col("key").asc_nulls_last(), F.col("c_custkey").asc()], "place").select("c_custkey", "place")


GESTURE = "nod > 0.6 AND shake > 0.6 AND abs(nod - shake) < 0.15"


@query(
    f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS nod, l_discount * 10 AS shake FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {GESTURE} THEN 'ambiguous_wobble' WHEN nod > 0.6 AND nod > shake THEN 'affirming_nod' WHEN shake > 0.6 THEN 'negating_shake' ELSE 'none' END AS gesture,
  {rounded(f"(CASE WHEN {GESTURE} THEN (nod + shake) / 2 WHEN nod > 0.6 AND nod > shake THEN nod WHEN shake > 0.6 THEN shake ELSE 0.0 END)", 4)} AS confidence FROM g"""
)
def gesture_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and discounts stand for the confidences of a nod and a shake."""
    g = M.gesture(F.col("l_quantity") / 50, F.col("l_discount") * 10)
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", g.alias("g"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("g.label").alias("gesture"), M.r(F.col("g.confidence"), 4).alias("confidence"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, l_quantity - 30) AS x1, greatest(0.0, l_linenumber - 5.0) AS y1, least(15.0, l_quantity - 20) AS x2, least(4.0, l_linenumber + 5.0) AS y2 FROM lineitem)
SELECT * FROM b WHERE x2 > x1 AND y2 > y1"""
)
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points padded by 5 to boxes and clamped to a frame of 15 by 4; those that are left without an area go."""
    x, y, names = F.col("l_quantity") - 25, F.col("l_linenumber").cast("double"), ("x1", "y1", "x2", "y2")
    box = M.clamp_box(x, y, x, y, F.lit(15.0), F.lit(4.0), F.lit(5.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(n) for c, n in zip(box, names)))
    return rows.where(L.sound_box(*(F.col(n) for n in names)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(CAST(l_quantity AS DECIMAL(18, 6)) / 8, 2) AS DOUBLE) AS eighths FROM lineitem")
def half_even_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths are exact in binary, so every fourth of them is a tie at two digits."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.py_round(F.col("l_quantity") / 8, 2).alias("eighths"))


SEEN = """d AS (SELECT *, least(l_discount * 10, 1.0) AS head, l_tax * 12.5 AS shoulder FROM lineitem), own AS (
  SELECT * FROM d WHERE NOT ((l_quantity > 0.95 * 50 AND l_linenumber > 0.15 * 50) OR (l_linenumber = 0 AND l_quantity > 0.9 * 50)) AND head >= 0.3 AND shoulder >= 0.3
)"""


@query(
    f"""WITH {SEEN}, plain AS (SELECT l_orderkey FROM own GROUP BY l_orderkey HAVING count(DISTINCT l_shipdate) >= 2), faces AS (
  SELECT DISTINCT l_orderkey, l_shipdate FROM own WHERE NOT (l_quantity > 0.80 * 50 AND l_returnflag = 'R')
), said AS (SELECT l_orderkey, l_shipdate, max(l_tax) > 0.04 AS several, max(l_tax) > 0.07 AS stereo FROM lineitem GROUP BY 1, 2), asked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS i FROM faces JOIN said USING (l_orderkey, l_shipdate)
), sure AS (SELECT l_orderkey FROM asked GROUP BY l_orderkey HAVING count(*) FILTER (WHERE several AND i <= 5) >= 2 AND NOT bool_or(stereo AND i = 1))
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM plain) AS present, o_orderkey IN (SELECT l_orderkey FROM sure) AS verified FROM orders"""
)
def social_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for recordings, ship dates for frames, lines for detections; discounts and taxes for what is visible."""
    from ..plans.presence import presence

    lines = table(spark, sf_dir, "lineitem")
    conf = F.concat(F.array_repeat(F.least(F.col("l_discount") * 10, F.lit(1.0)), 5), F.array_repeat(F.col("l_tax") * 12.5, 2))
    seen = lines.select(
        F.col("l_orderkey").alias("video_id"), F.col("l_shipdate").alias("frame"), F.col("l_linenumber").alias("y1"), F.col("l_quantity").alias("y2"), F.lit(50.0).alias("height"), conf.alias("keypoints"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("face_up"),
    )
    said = lines.groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_shipdate").alias("frame")).agg((F.max("l_tax") > 0.04).alias("several"), (F.max("l_tax") > 0.07).alias("stereo"))
    videos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"))
    plain, verified = presence(videos, seen), presence(videos, seen, said).withColumnRenamed("present", "verified")
    return plain.join(verified, "video_id").withColumnRenamed("video_id", "o_orderkey")


@query("SELECT n_nationkey, n_regionkey < 2 OR n_regionkey = 3 AS kept FROM nation")
def streaming_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions 0 and 1 are confirmed, 2 and 4 rejected, 3 has no decision and stays."""
    from ..plans.presence import kept_recordings

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("video_id"), "n_regionkey")
    decisions = n.where("n_regionkey <> 3").select("video_id", (F.col("n_regionkey") < 2).alias("present"))
    kept = kept_recordings(n.select("video_id"), decisions).withColumn("kept", F.lit(True))
    return n.join(kept, "video_id", "left").select(F.col("video_id").alias("n_nationkey"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query(
    """WITH c AS (SELECT l_orderkey, l_partkey * 100000 + CAST(l_quantity AS BIGINT) * 100 + l_linenumber AS idx, CASE WHEN l_partkey % 5 > 0 THEN l_discount END AS iou, CASE WHEN l_tax > 0 THEN l_quantity * l_tax END AS spread FROM lineitem), m AS (
  SELECT l_orderkey, idx, CASE WHEN count(iou) OVER p = count(*) OVER p THEN iou ELSE coalesce(spread, -1.0) END AS s FROM c WINDOW p AS (PARTITION BY l_orderkey)
) SELECT l_orderkey, idx FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, idx) AS k FROM m) WHERE k = 1"""
)
def pose_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for the poses found in a crop: discounts for overlaps with it, some missing; quantity and tax for the spread of keypoints."""
    idx = F.col("l_partkey") * 100000 + F.col("l_quantity").cast("long") * 100 + F.col("l_linenumber")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", idx.alias("idx"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount")).alias("iou"), F.when(F.col("l_tax") > 0, F.col("l_quantity") * F.col("l_tax")).alias("spread"))
    return L.pose_pick(x, ["l_orderkey"], "idx", "iou", "spread").select("l_orderkey", "idx")
