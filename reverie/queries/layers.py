"""The layer plans on stand-ins: customers are recordings, urgent orders tasks, line items what was seen of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import layers as L
from ..plans import records as R
from ..sources.shared import stored
from .base import query, rounded, table

#: Of the tables below: when a line item was seen, in days; no two of a person share a time.
_SEEN = "(l_partkey * 7919 + l_orderkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863) % 1048576 / 1048576.0"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """recordings, tasks, persons, boxes, depth, noise, flow, keypoints and traces."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    recordings = customers.select(F.col("c_custkey").cast("string").alias("video_id"), "c_mktsegment", "c_nationkey", (F.col("c_acctbal") >= 1000).alias("peopled"))
    tasks = orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("task_pos"), F.col("o_orderkey").cast("string").alias("task_id"), "o_totalprice",
        F.when(F.col("o_orderstatus") != "O", (F.col("o_orderkey") % 8).cast("double")).alias("win_start"), F.when(F.col("o_orderstatus") != "O", (F.col("o_orderkey") % 8 + 32).cast("double")).alias("win_end"),
    )
    day = F.expr("CAST(floor(unix_micros(CAST(l_shipdate AS TIMESTAMP)) / 86400000000) % 48 AS DOUBLE)") + F.expr(_SEEN.replace(".0", "D"))
    items = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("video_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select("video_id", (F.col("l_suppkey") % 3).alias("person_id"), day.alias("t"), "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey")
    items, _ = stored(items, "items")  # what every table below begins with
    peopled = items.join(recordings.where("peopled").select("video_id"), "video_id", "left_semi")
    x1, y1 = (F.col("l_partkey") % 1500).cast("double"), (F.col("l_suppkey") * 7 % 800).cast("double")
    boxes = peopled.where("l_returnflag = 'A'").select("video_id", "person_id", "t", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity")).alias("x2"), (y1 + 50).alias("y2"))
    persons = items.select("video_id", "person_id").distinct().join(recordings.where("peopled").select("video_id"), "video_id", "left_semi").withColumn("person_pos", -F.col("person_id"))
    # what is shown of a task lies in its window, or at most a quarter of a second before it
    in_tasks = items.join(tasks.select("video_id", "task_id", "win_start", "win_end"), "video_id").where("t BETWEEN win_start - 0.25 AND win_end").drop("win_start", "win_end")
    ends = [(0.0, 0.0), (0.25, 1.0)]
    shown = [F.struct((F.col("t") + at).alias("t"), F.lit(k).alias("kpt"), F.lit(0.1).alias("x") + (F.col("l_discount") * move if k == 5 else 0.0), F.lit(y) + (F.col("l_tax") * move if k == 11 else 0.0)) for at, move in ends for k, y in ((5, 0.2), (11, 0.6))]
    posed = in_tasks.where("l_returnflag = 'N'").join(recordings.where("c_nationkey % 5 <> 1").select("video_id"), "video_id", "left_semi")
    points = posed.select("video_id", "task_id", "person_id", F.explode(F.array(*(s.cast("struct<t:double,kpt:int,x:double,y:double>") for s in shown))).alias("p"))
    n_tasks, n_people = (df.groupBy("video_id").agg(F.count("*").alias(name)) for df, name in ((tasks, "n_tasks"), (persons, "n_bystanders")))
    counted = recordings.join(n_tasks, "video_id", "left").join(n_people, "video_id", "left").fillna(0, ["n_tasks", "n_bystanders"])
    return {
        "recordings": counted.select("video_id", (F.col("c_mktsegment") != "BUILDING").alias("found"), F.when(F.col("c_nationkey") % 6 == 0, 0.0).otherwise(1920.0).alias("width"), F.lit(1080.0).alias("height"), F.lit(30.0).alias("fps"), "n_tasks", "n_bystanders"),
        "tasks": tasks,
        "persons": persons,
        "boxes": boxes,
        "depth": in_tasks.where("l_quantity > 20").select("video_id", "task_id", "person_id", "t", F.col("l_tax").alias("depth")),
        "noise": tasks.where("o_totalprice > 50000").select("video_id", "task_id", (F.col("o_totalprice") / 20000).alias("noise")),
        "flow": in_tasks.where("l_quantity > 25").select("video_id", "task_id", (F.col("t") + 0.125).alias("t"), (F.col("l_extendedprice") / 20000).alias("mean_mag"), (F.col("l_extendedprice") / 20000).alias("p95_mag"), (F.col("l_discount") * 100 - 5).alias("mean_dx"), (F.col("l_tax") * 100 - 4).alias("mean_dy")),
        "keypoints": points.select("video_id", "task_id", "person_id", "p.*"),
        "traces": items.join(recordings.where("c_mktsegment <> 'FURNITURE'").select("video_id", F.when(F.col("c_nationkey") % 2 == 0, "crossgaze").otherwise("l2cs_net_3d_gaze").alias("model")), "video_id").select(
            "video_id", "model", F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0).alias("person_id"), "t", F.when(F.col("l_discount") < 0.03, float("nan")).otherwise(F.col("l_discount")).alias("pitch_rad"), F.col("l_tax").alias("yaw_rad")
        ),
    }


STANDINS = f"""rec AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, c_mktsegment <> 'BUILDING' AS found, c_mktsegment <> 'FURNITURE' AS traced, CASE WHEN c_nationkey % 2 = 0 THEN 0.2 ELSE 0.3 END AS most, c_nationkey % 5 <> 1 AS posed, c_acctbal >= 1000 AS peopled, CASE WHEN c_nationkey % 6 = 0 THEN 0.0 ELSE 1920.0 END AS width FROM customer
), tasks AS (
  SELECT CAST(o_custkey AS VARCHAR) AS video_id, o_orderkey AS task, CASE WHEN o_totalprice > 50000 THEN o_totalprice / 20000 ELSE 0.0 END AS noise,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 8 AS DOUBLE) END AS w0, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 8 + 32 AS DOUBLE) END AS w1
  FROM orders WHERE o_orderpriority = '1-URGENT'
), items AS (
  SELECT CAST(o_custkey AS VARCHAR) AS video_id, l_suppkey % 3 AS person, CAST((epoch_us(l_shipdate) // 86400000000) % 48 AS DOUBLE) + CAST({_SEEN} AS DOUBLE) AS t, l.*
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
), boxes AS (
  SELECT i.video_id, person, t, CAST(l_partkey % 1500 AS DOUBLE) AS x1, CAST(l_suppkey * 7 % 800 AS DOUBLE) AS y1, l_partkey % 1500 + l_quantity AS x2, CAST(l_suppkey * 7 % 800 + 50 AS DOUBLE) AS y2
  FROM items i JOIN rec USING (video_id) WHERE peopled AND l_returnflag = 'A'
), counted AS (
  SELECT rec.*, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_people, 0) AS n_people FROM rec
  LEFT JOIN (SELECT video_id, count(*) AS n_tasks FROM tasks GROUP BY 1) USING (video_id)
  LEFT JOIN (SELECT video_id, count(DISTINCT person) AS n_people FROM items JOIN rec USING (video_id) WHERE peopled GROUP BY 1) USING (video_id)
), open AS (SELECT t.*, found, posed, n_people, width FROM tasks t JOIN counted USING (video_id) WHERE w0 IS NOT NULL
), flow AS (
  SELECT o.video_id, task, t + 0.125 AS t, l_extendedprice / 20000 AS mag, l_discount * 100 - 5 AS dx, l_tax * 100 - 4 AS dy, n_people
  FROM open o JOIN items USING (video_id) WHERE l_quantity > 25 AND t + 0.125 BETWEEN w0 AND w1
)"""

PROXEMIC = f"""area AS (
  SELECT o.video_id, task, person, any_value(noise) AS noise, any_value(w0) AS w0, any_value(w1) AS w1,
    CASE WHEN min_by((x2 - x1) * (y2 - y1), b.t) > 0 THEN (max_by((x2 - x1) * (y2 - y1), b.t) - min_by((x2 - x1) * (y2 - y1), b.t)) / min_by((x2 - x1) * (y2 - y1), b.t) * 100 ELSE 0.0 END AS area
  FROM open o JOIN boxes b USING (video_id) WHERE found AND b.t BETWEEN w0 AND w1 GROUP BY ALL HAVING count(*) >= 2
), deep AS (
  SELECT a.video_id, task, a.person, i.t, l_tax AS depth, row_number() OVER w - 1 AS i, count(*) OVER p AS n, greatest(5, least(20, CAST(floor((max(i.t) OVER p - min(i.t) OVER p) * 3.0) AS INTEGER))) AS k
  FROM area a JOIN items i ON i.video_id = a.video_id AND i.person = a.person AND l_quantity > 20 AND i.t BETWEEN w0 AND w1 WHERE noise <= 15
  WINDOW w AS (PARTITION BY a.video_id, task, a.person ORDER BY i.t), p AS (PARTITION BY a.video_id, task, a.person)
), picked AS (
  SELECT * FROM deep WHERE n <= k OR i = n - 1 OR i IN (SELECT CAST(floor(j * ((n - 1) / (k - 1))) AS BIGINT) FROM range(20) AS g(j) WHERE j < k - 1)
), slope AS (SELECT video_id, task, person, regr_slope(depth, t) * (max(t) - min(t)) AS delta FROM picked GROUP BY ALL HAVING count(*) >= 2
), scored AS (
  SELECT a.video_id, task, person, area, 0.0 AS delta, 0.0 AS vector, 0.0 AS confidence, noise FROM area a WHERE noise > 15
  UNION ALL SELECT a.video_id, a.task, a.person, area, delta, CASE WHEN abs(v) < 0.05 THEN 0.0 ELSE {rounded("v", 2)} END, 1 - abs(sign(area) - sign(-delta)) / 2, noise
  FROM (SELECT a.*, delta, 0.4 * least(1.0, greatest(-1.0, area / 50)) + 0.6 * least(1.0, greatest(-1.0, -2 * delta)) AS v FROM area a JOIN slope s USING (video_id, task, person) WHERE noise <= 15) a
)"""


@query(
    f"""WITH {STANDINS}, {PROXEMIC}
SELECT video_id, CAST(task AS VARCHAR) AS task_id, person AS person_id, {rounded("area", 2)} AS area_delta_pct, {rounded("delta", 4)} + 0.0 AS depth_delta, vector + 0.0 AS proxemic_vector,
  CASE WHEN vector > 0.3 THEN 'Approach_Intervention' WHEN vector < -0.3 THEN 'Avoidance' ELSE 'Neutral' END AS classified_action, {rounded("confidence", 2)} AS proxemic_confidence, {rounded("noise", 2)} AS optical_flow_noise FROM scored"""
)
def proxemic_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables(spark, sf_dir)
    own = R.windows(x["tasks"]).join(x["recordings"].where("found").select("video_id"), "video_id", "left_semi")
    out = L.proxemics(x["boxes"], x["depth"], x["noise"], own)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("depth_delta", "proxemic_vector")})


RESONANCE = f"""pts AS (
  SELECT o.video_id, task, person, i.t + d.later AS t, k.kpt, 0.1 + CASE WHEN k.kpt = 5 THEN l_discount * d.move ELSE 0.0 END AS x, k.y + CASE WHEN k.kpt = 11 THEN l_tax * d.move ELSE 0.0 END AS y
  FROM open o JOIN items i USING (video_id), (VALUES (0.0, 0.0), (0.25, 1.0)) AS d(later, move), (VALUES (5, 0.2::DOUBLE), (11, 0.6::DOUBLE)) AS k(kpt, y)
  WHERE found AND posed AND n_people > 0 AND l_returnflag = 'N' AND i.t + d.later BETWEEN w0 AND w1
), placed AS (SELECT *, dense_rank() OVER (PARTITION BY video_id, task, person ORDER BY t) AS n FROM pts
), moves AS (
  SELECT a.video_id, a.task, a.person, a.t, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / (a.t - b.t) AS velocity
  FROM placed a JOIN placed b ON a.video_id = b.video_id AND a.task = b.task AND a.person = b.person AND a.kpt = b.kpt AND a.n = b.n + 1 WHERE a.t - b.t > 0 AND a.t - b.t <= 0.5 GROUP BY a.video_id, a.task, a.person, a.t, b.t
), peaks AS (SELECT video_id, task, person, max(velocity) AS peak, arg_min(t, {{'v': -velocity, 't': t}}) AS peak_t FROM moves WHERE velocity > 0 GROUP BY ALL
), angles AS (
  SELECT video_id, task, person, t, atan2(avg(y) FILTER (kpt = 5) - avg(y) FILTER (kpt = 11), avg(x) FILTER (kpt = 5) - avg(x) FILTER (kpt = 11)) AS angle FROM pts GROUP BY ALL HAVING count(DISTINCT kpt) = 2
), moved AS (SELECT f.* FROM flow f JOIN counted c USING (video_id) WHERE found AND c.n_people > 0
), chaos AS (SELECT video_id, task, max(mag) AS most FROM moved GROUP BY ALL
), spikes AS (SELECT m.* FROM moved m JOIN chaos USING (video_id, task) WHERE most >= 3.0 AND mag > 0.7 * most
), delays AS (
  SELECT p.video_id, p.task, person, min(peak_t - s.t) AS delay FROM peaks p JOIN spikes s ON s.video_id = p.video_id AND s.task = p.task AND peak_t - s.t > 0 AND peak_t - s.t <= 0.5 GROUP BY ALL
), turns AS (
  SELECT m.video_id, m.task, person, m.t, avg(angle) FILTER (a.t BETWEEN m.t - 0.5 AND m.t) AS before, avg(angle) FILTER (a.t > m.t AND a.t <= m.t + 0.5) AS after
  FROM moved m JOIN angles a ON a.video_id = m.video_id AND a.task = m.task AND a.t BETWEEN m.t - 0.5 AND m.t + 0.5 WHERE dy < -1.0 GROUP BY ALL
), mirrored AS (SELECT video_id, task, person, arg_min(abs(after - before), t) AS change FROM turns WHERE abs(after - before) > 0.1 GROUP BY ALL
), people AS (SELECT video_id, task, person FROM moves UNION SELECT video_id, task, person FROM angles
), resonant AS (
  SELECT p.video_id, p.task, p.person, most, least(10.0, coalesce(peak, 0) / 0.5) AS peak, delay, change FROM people p JOIN chaos USING (video_id, task)
  LEFT JOIN peaks USING (video_id, task, person) LEFT JOIN delays USING (video_id, task, person) LEFT JOIN mirrored USING (video_id, task, person)
)"""


@query(
    f"""WITH {STANDINS}, {RESONANCE}
SELECT video_id, CAST(task AS VARCHAR) AS task_id, person AS person_id, {rounded("least(1.0, most / 20)", 2)} AS ego_kinetic_chaos_score, {rounded("peak", 2)} AS bystander_pose_velocity_peak, {rounded("coalesce(delay, 0.0)", 2)} AS resonance_delay_sec,
  delay IS NOT NULL AS motor_resonance_detected, CASE WHEN delay IS NOT NULL THEN {rounded("least(1.0, peak / 5)", 2)} ELSE 0.0 END AS empathy_scalar, change IS NOT NULL AS mirroring_detected, {rounded("least(1.0, coalesce(change, 0.0) / 0.5)", 2)} AS mirroring_scalar FROM resonant"""
)
def resonance_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables(spark, sf_dir)
    own = R.windows(x["tasks"]).join(x["recordings"].where("found AND n_bystanders > 0").select("video_id"), "video_id", "left_semi").select(*L.TASK, "win_start", "win_end")
    flow, points = (L.within(x[name], own, L.TASK).drop("win_start", "win_end") for name in ("flow", "keypoints"))
    return L.resonance(flow, points)


SHARED = f"""shifts AS (SELECT video_id, task, {rounded("sum(-dx)", 2)} AS sx, {rounded("sum(-dy)", 2)} AS sy FROM flow GROUP BY ALL
), centred AS (
  SELECT o.video_id, task, bool_or(t >= w1 - 0.25 * (w1 - w0) AND (x1 + x2) / 2 / width BETWEEN 0.35 AND 0.65 AND (y1 + y2) / 2 / 1080 BETWEEN 0.35 AND 0.65) AS centred
  FROM open o JOIN boxes USING (video_id) WHERE t BETWEEN w0 AND w1 AND width > 0 GROUP BY ALL
), social AS (
  SELECT o.video_id, task, coalesce(sx, 0.0) AS shift_x, coalesce(sy, 0.0) AS shift_y, coalesce(centred, false) AS centred FROM open o LEFT JOIN shifts USING (video_id, task) LEFT JOIN centred USING (video_id, task) WHERE found AND width > 0 AND n_people > 0
)"""


@query(
    f"""WITH {STANDINS}, {SHARED}
SELECT video_id, CAST(task AS VARCHAR) AS task_id, shift_x + 0.0 AS shift_x, shift_y + 0.0 AS shift_y, centred AS bystander_centered_in_fov, centred AND sqrt(shift_x ** 2 + shift_y ** 2) > 0.04 * sqrt(1920.0 ** 2 + 1080.0 ** 2) AS social_reference_sought FROM social"""
)
def shared_reality_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tables(spark, sf_dir)
    there = x["recordings"].where("found AND width > 0 AND n_bystanders > 0")
    out = L.shared_reality(x["flow"], x["boxes"], R.windows(x["tasks"]).join(there.select("video_id"), "video_id", "left_semi"), there)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("shift_x", "shift_y")})


@query(
    f"""WITH {STANDINS}, {PROXEMIC}, {RESONANCE}, {SHARED}, spans AS (
  SELECT o.video_id, task, CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS person, count(*) AS n, max(t) - min(t) AS span, count(*) FILTER (l_discount < 0.03) / count(*) AS missing, any_value(most) AS most
  FROM open o JOIN items USING (video_id) JOIN rec USING (video_id) WHERE traced AND t BETWEEN w0 AND w1 GROUP BY ALL
), nods AS (SELECT * FROM spans WHERE n >= 5 AND span > 0 AND missing <= most AND greatest(5, floor(span * (1 / (span / (n - 1))))) > 15
), counts AS (
  SELECT 'd' AS layer, video_id, count(DISTINCT task) AS tasks, count(*) AS persons FROM scored GROUP BY 2
  UNION ALL SELECT 'e', video_id, count(DISTINCT task), count(*) FROM nods GROUP BY 2
  UNION ALL SELECT 'f', video_id, count(DISTINCT task), count(*) FROM resonant GROUP BY 2
  UNION ALL SELECT 'g', video_id, count(*), 0 FROM social GROUP BY 2
), reasons AS (
  SELECT 'd' AS layer, '03d_proxemic_kinematics' AS name, video_id, 'no_output_produced' AS reason FROM counted
  UNION ALL SELECT 'e', '03e_affirmation_gesture', video_id, CASE WHEN NOT traced OR video_id NOT IN (SELECT video_id FROM items) THEN 'no_attention_data' WHEN n_tasks = 0 THEN 'no_tasks' ELSE 'insufficient_trace' END FROM counted
  UNION ALL SELECT 'f', '03f_motor_resonance', video_id, CASE WHEN NOT found THEN 'file_not_found' WHEN n_tasks = 0 OR n_people = 0 THEN 'no_bystanders_or_tasks' WHEN video_id NOT IN (SELECT video_id FROM spikes) THEN 'no_ego_spikes' ELSE 'no_pose_data' END FROM counted
  UNION ALL SELECT 'g', '03g_shared_reality', video_id, CASE WHEN NOT found OR width = 0 THEN 'missing_video' WHEN n_tasks = 0 OR n_people = 0 THEN 'no_bystanders_or_tasks' ELSE 'no_valid_tasks' END FROM counted
)
SELECT name AS layer, video_id, coalesce(tasks, 0) AS n_tasks, coalesce(persons, 0) AS n_persons, CASE WHEN tasks IS NULL THEN reason END AS skipped_reason FROM reasons LEFT JOIN counts USING (layer, video_id)"""
)
def layer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks and persons each layer's record of a recording holds, or why it holds none."""
    x = tables(spark, sf_dir)
    for name in ("recordings", "persons"):  # every layer reads them, some more than once
        x[name], _ = stored(x[name], name)
    common = [x[c] for c in ("recordings", "tasks", "persons")]
    made = [
        R.proxemics(*common, x["boxes"], x["depth"], x["noise"]),
        R.gesture(*common, x["traces"]),
        R.resonance(*common, x["flow"], x["keypoints"]),
        R.shared_reality(x["recordings"], x["tasks"], x["boxes"], x["flow"]),
    ]
    out = None
    for df in made:
        people = F.aggregate("tasks_analyzed", F.lit(0), lambda n, t: n + F.size(t["per_person"])) if "per_person" in df.schema["tasks_analyzed"].dataType.elementType.names else F.lit(0)
        part = df.select("layer", "video_id", F.size("tasks_analyzed").cast("long").alias("n_tasks"), people.cast("long").alias("n_persons"), "skipped_reason")
        out = part if out is None else out.union(part)
    return out
