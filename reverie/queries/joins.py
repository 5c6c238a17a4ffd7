"""Joins, lookups, set operations and the wide export row on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import r
from ..functions.text import schema_hash
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..plans.export import wide_rows
from ..plans.models import with_installed_tag
from .base import TRACE, query, rounded, table, trace


@query(
    f"""WITH base AS (SELECT c_custkey AS k, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (
  SELECT o_custkey AS k, {rounded("avg(o_totalprice)", 4)} AS avg_price, max(o_totalprice) AS max_price, bool_or(o_orderstatus = 'F') AS any_final FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey
), ranked AS (
  SELECT o_custkey AS k, l_tax - 0.041 AS v, l_quantity, l_discount, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(l_tax - 0.041) DESC, l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
), l AS (
  SELECT k, max(CASE WHEN i = 1 THEN v END) AS max_abs_tax, max(l_quantity) AS max_quantity, bool_or(l_discount > 0.08) AS any_discount FROM ranked GROUP BY k
) SELECT k AS custkey, c_mktsegment, c_nationkey, avg_price, max_price, any_final, {rounded("max_abs_tax", 4)} AS max_abs_tax, max_quantity, any_discount FROM base FULL OUTER JOIN o USING (k) FULL OUTER JOIN l USING (k)"""
)
def wide_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per customer from three independent sources; what a source lacks is null."""
    base = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"), "c_mktsegment", "c_nationkey")
    orders = table(spark, sf_dir, "orders")
    o = orders.where(F.col("o_orderpriority").startswith("1")).groupBy(F.col("o_custkey").alias("custkey"))
    o = o.agg(r(F.avg("o_totalprice"), 4).alias("avg_price"), F.max("o_totalprice").alias("max_price"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.col("l_tax") - 0.041
    first = F.struct((-F.col("l_orderkey")).alias("a"), (-F.col("l_linenumber")).alias("b"), (-F.col("l_partkey")).alias("c"))
    ln = lines.groupBy(F.col("o_custkey").alias("custkey")).agg(
        r(F.max_by(value, F.struct(F.abs(value), first)), 4).alias("max_abs_tax"), F.max("l_quantity").alias("max_quantity"), F.bool_or(F.col("l_discount") > 0.08).alias("any_discount")
    )
    return J.outer_fold([base, o, ln], "custkey")


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Customers as recordings; their orders as tasks of two layers, order lines as the persons of one."""
    customers = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    orders = table(spark, sf_dir, "orders")
    labels = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderpriority").alias("task_label")).alias("t")))).alias("x"))
    manifest = customers.join(labels, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").cast("string").alias("video_id"), F.col("c_mktsegment").alias("source_dataset"), F.col("c_acctbal").alias("duration_sec"), F.lit(30.0).alias("fps"),
        F.coalesce(F.transform("x", lambda y: y["t"]), F.array().cast("array<struct<task_label:string>>")).alias("identified_tasks"),
    )
    tasks = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("task_id"), (F.col("o_totalprice") / 1000).alias("task_aggregate_score")))).alias("tasks_analyzed"))
    emotion = tasks.select(F.col("o_custkey").cast("string").alias("video_id"), F.lit("03b").alias("layer"), "tasks_analyzed", F.when(F.size("tasks_analyzed") > 9, "busy").alias("skipped_reason"))
    lines = table(spark, sf_dir, "lineitem")
    person = F.struct(
        F.col("l_partkey").alias("person_id"), F.col("l_quantity").alias("q"), (F.col("l_tax") - 0.041).alias("proxemic_vector"), F.col("l_discount").alias("proxemic_confidence"),
        F.when(F.col("l_returnflag") == "R", "Approach").when(F.col("l_returnflag") == "A", "Retreat").otherwise("Neutral").alias("classified_action"),
    )
    people = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(person)).alias("per_person"))
    near = orders.join(people, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("task_id"), "per_person"))).alias("tasks_analyzed"))
    proxemics = near.select(F.col("o_custkey").cast("string").alias("video_id"), "tasks_analyzed")
    return manifest, {"03b_reasonable_emotion": emotion, "03d_proxemic_kinematics": proxemics}


@query(
    f"""WITH base AS (SELECT CAST(c_custkey AS VARCHAR) AS video_id, c_mktsegment AS source_dataset, coalesce((SELECT string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'), 'Unknown') AS task_labels,
  c_acctbal AS duration_sec, 30.0::DOUBLE AS fps FROM customer WHERE c_mktsegment <> 'BUILDING'), e AS (
  SELECT CAST(o_custkey AS VARCHAR) AS video_id, {rounded("avg(o_totalprice / 1000)", 4)} AS avg_task_score, CASE WHEN count(*) > 9 THEN 'busy' END AS skipped_reason, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS raw_tasks FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
), p AS (
  SELECT CAST(o_custkey AS VARCHAR) AS video_id, l_discount, l_returnflag, l_tax - 0.041 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(l_tax - 0.041) DESC, o_orderkey, l_partkey, l_quantity) AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), d AS (
  SELECT video_id, max(l_discount) AS max_confidence, max(CASE WHEN i = 1 THEN v END) AS max_abs_vector, bool_or(l_returnflag = 'R') AS any_approach, bool_or(l_returnflag = 'A') AS any_retreat FROM p GROUP BY video_id
) SELECT video_id, source_dataset, task_labels, duration_sec, fps, avg_task_score, skipped_reason, raw_tasks, max_confidence, {rounded("max_abs_vector", 4)} AS max_abs_vector, any_approach, any_retreat FROM base FULL OUTER JOIN e USING (video_id) FULL OUTER JOIN d USING (video_id)"""
)
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export row: base columns, and each layer's summaries by the registry."""
    manifest, layers = _layers(spark, sf_dir)
    wide = wide_rows(manifest, layers)
    return wide.select(
        "video_id", "source_dataset", "task_labels", "duration_sec", "fps", F.col("03b_reasonable_emotion_avg_task_score").alias("avg_task_score"), F.col("03b_reasonable_emotion_skipped_reason").alias("skipped_reason"),
        F.array_join(F.from_json(F.col("03b_reasonable_emotion_tasks_analyzed_raw"), "array<struct<task_id:bigint>>")["task_id"].cast("array<string>"), ",").alias("raw_tasks"),
        F.col("03d_proxemic_kinematics_max_proxemic_confidence").alias("max_confidence"), r(F.col("03d_proxemic_kinematics_max_abs_proxemic_vector"), 4).alias("max_abs_vector"),
        F.col("03d_proxemic_kinematics_any_approach_detected").alias("any_approach"), F.col("03d_proxemic_kinematics_any_retreat_detected").alias("any_retreat"),
    )


def _nearest_sql(tolerance: float | None) -> str:
    limit = f"AND abs(b.t - s.t) <= {tolerance}" if tolerance else ""
    return f"""WITH {TRACE}, s AS (SELECT * FROM trace WHERE event_type = 'purchase'), b AS (SELECT * FROM trace WHERE event_type = 'view'), c AS (
  SELECT s.event_id, b.event_id AS box_id, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(b.t - s.t), b.t, b.event_id) AS k FROM s JOIN b ON s.user_id = b.user_id {limit}
) SELECT s.event_id, box_id FROM s LEFT JOIN c ON c.event_id = s.event_id AND k = 1"""


def _nearest(spark: SparkSession, sf_dir: str, tolerance: float | None) -> DataFrame:
    x = trace(spark, sf_dir)
    left = x.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = x.where("event_type = 'view'").select("user_id", F.col("event_id").alias("box_id"), F.col("t").alias("box_t"))
    return J.nearest_join(left, right, ["user_id"], "t", "box_t", ["box_t", "box_id"], tolerance, ["event_id"]).select("event_id", "box_id")


@query(_nearest_sql(200_000.0))
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the nearest view of its user in either direction, within a tolerance."""
    return _nearest(spark, sf_dir, 200_000.0)


@query(_nearest_sql(None))
def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, None)


@query(
    f"""WITH {TRACE}, w AS (SELECT user_id, min(t) + 0.25 * (max(t) - min(t)) AS s, min(t) + 0.5 * (max(t) - min(t)) AS e FROM trace GROUP BY user_id)
SELECT user_id, count(*) AS n, {rounded("sum(value)", 2)} AS total FROM trace JOIN w USING (user_id) WHERE t BETWEEN s AND e GROUP BY user_id"""
)
def window_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir)
    span = F.max("t") - F.min("t")
    w = x.groupBy("user_id").agg((F.min("t") + 0.25 * span).alias("s"), (F.min("t") + 0.5 * span).alias("e"))
    return J.interval_join(x, w, ["user_id"], "t", "s", "e").groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query(
    f"""WITH {TRACE}, s AS (SELECT user_id, t FROM trace WHERE event_type = 'signup'), e AS (SELECT user_id, t AS p FROM trace WHERE event_type = 'error'), d AS (
  SELECT user_id, min(p - t) AS d FROM s JOIN e USING (user_id) WHERE p - t > 0 AND p - t <= 300000 GROUP BY user_id
) SELECT user_id, d IS NOT NULL AS detected, {rounded("coalesce(d, 0.0)", 4)} AS delay FROM (SELECT DISTINCT user_id FROM s) LEFT JOIN d USING (user_id)"""
)
def spike_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = trace(spark, sf_dir)
    spikes, peaks = x.where("event_type = 'signup'").select("user_id", "t"), x.where("event_type = 'error'").select("user_id", F.col("t").alias("p"))
    return J.spike_response(spikes, peaks, ["user_id"], "t", "p", 300_000.0).withColumn("delay", r(F.col("delay"), 4))


@query(
    f"""WITH {TRACE}, f AS (SELECT user_id, t FROM trace WHERE event_type = 'purchase'), a AS (SELECT user_id, t AS u, score FROM trace WHERE event_type = 'view'), m AS (
  SELECT user_id, t, avg(CASE WHEN u BETWEEN t - 400000 AND t THEN score END) AS b, avg(CASE WHEN u > t AND u <= t + 400000 THEN score END) AS c FROM f JOIN a USING (user_id) WHERE abs(u - t) <= 400000 GROUP BY user_id, t
), k AS (SELECT user_id, abs(c - b) AS d, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM m WHERE abs(c - b) > 0.1)
SELECT user_id, k.d IS NOT NULL AS mirroring_detected, {rounded("least(1.0, coalesce(k.d, 0.0) / 0.5)", 4)} AS mirroring_scalar FROM (SELECT DISTINCT user_id FROM f) LEFT JOIN (SELECT * FROM k WHERE i = 1) k USING (user_id)"""
)
def mirroring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundred thousands of seconds stand for tenths of one."""
    x = trace(spark, sf_dir)
    points = x.where("event_type = 'purchase'").select("user_id", "t")
    angles = x.where("event_type = 'view'").select("user_id", F.col("t").alias("u"), "score")
    out = A.mirroring(points.withColumn("dy", F.lit(-2.0)), angles, ["user_id"], "t", "dy", "u", "score", half=400_000.0)
    return out.withColumn("mirroring_scalar", r(F.col("mirroring_scalar"), 4))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unprocessed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def processed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return done.union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_orderkey AS id, o_totalprice AS score, CAST(NULL AS VARCHAR) AS flag FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_orderkey, CAST(NULL AS DOUBLE), l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return old.unionByName(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag")), allowMissingColumns=True)


@query(
    """WITH e AS (SELECT event_id, event_type || '.' || (user_id % 7) AS k, event_type AS b FROM events), d AS (SELECT event_type || '.' || u AS k, 10 + u AS v FROM (SELECT DISTINCT event_type FROM events), range(3) AS r(u) UNION ALL SELECT event_type, 1 FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'error')
SELECT event_id, CAST(coalesce(x.v, y.v) AS BIGINT) AS v FROM e LEFT JOIN d x ON e.k = x.k LEFT JOIN d y ON e.b = y.k"""
)
def metadata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import before_dot

    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("."), (F.col("user_id") % 7).cast("string")).alias("k"), "event_type")
    kinds = e.select("event_type").distinct()
    full = kinds.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("u"), "event_type").select(F.concat("event_type", F.lit("."), F.col("u").cast("string")).alias("k"), (F.col("u") + 10).cast("long").alias("v"))
    short = kinds.where("event_type <> 'error'").select(F.col("event_type").alias("k"), F.lit(1).cast("long").alias("v"))
    return J.lookup_with_fallback(e, full.union(short), "k", "v", before_dot(e["k"])).select("event_id", "v")


@query(
    """SELECT s_suppkey, coalesce(n_name, 'pinhole') AS model, CASE WHEN n_nationkey IS NOT NULL THEN CAST(s_nationkey AS DOUBLE) ELSE -640.0 END AS focal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <= 2"""
)
def intrinsics_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("k"), F.struct("n_name", F.col("n_nationkey").cast("double").alias("focal")).alias("v"))
    out = J.lookup_with_fallback(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k"), known, "k", "v", F.lit(-1))
    return out.select("s_suppkey", F.coalesce("v.n_name", F.lit("pinhole")).alias("model"), F.coalesce("v.focal", F.lit(-640.0)).alias("focal"))


@query(
    """WITH m AS (SELECT p_brand AS layer_key, p_type AS tier, p_name || ':' || p_size AS model_id, p_name AS base, CASE WHEN p_size > 5 THEN CAST(p_size * 1000 AS BIGINT) END AS bytes FROM part), i AS (
  SELECT p_name || ':' || p_size AS tag FROM part WHERE p_size % 3 = 0 UNION SELECT p_name || ':latest' FROM part WHERE p_size % 2 = 0
) SELECT layer_key, tier, model_id, bytes, CASE WHEN model_id NOT IN (SELECT tag FROM i) AND base || ':latest' IN (SELECT tag FROM i) THEN base || ':latest' ELSE model_id END AS resolved_id FROM m"""
)
def resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for models, sizes for their versions."""
    p = table(spark, sf_dir, "part")
    own = F.concat("p_name", F.lit(":"), F.col("p_size").cast("string"))
    models = p.select(F.col("p_brand").alias("layer_key"), F.col("p_type").alias("tier"), own.alias("model_id"), F.when(F.col("p_size") > 5, F.col("p_size").cast("long") * 1000).alias("bytes"))
    installed = p.where("p_size % 3 = 0").select(own.alias("tag")).union(p.where("p_size % 2 = 0").select(F.concat("p_name", F.lit(":latest")))).distinct()
    return with_installed_tag(models, installed)


@query("SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 1.0) AS weight, CASE WHEN l.doc_id IS NULL THEN 'no_attention_data' WHEN quality = 0 THEN 'insufficient_trace' END AS skipped_reason FROM documents LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NULL", "quality IS NULL"))
def sentinel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.records import skipped_reason

    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = docs.join(labels, "doc_id", "left")
    reason = skipped_reason("03e_affirmation_gesture", {"no_attention_data": F.col("quality").isNull(), "insufficient_trace": F.col("quality") == 0})
    return out.select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(1.0)).alias("weight"), reason.alias("skipped_reason"))


@query("SELECT count(*) FILTER (WHERE x.k IS NOT NULL) AS matched, count(*) FILTER (WHERE x.k IS NULL) AS missing, count(*) AS total FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) x ON x.k = o_orderkey")
def rehydrate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import match_counts, rehydrate

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"))
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/data/"), F.col("l_orderkey").cast("string"), F.lit(".mp4")).alias("file_path"))
    return match_counts(rehydrate(rows, files))


@query(
    f"""WITH m AS (SELECT l_linenumber % 5 AS fold, l_suppkey % 7 AS epoch, avg(l_discount * 100) AS e FROM lineitem GROUP BY 1, 2), a AS (SELECT epoch, avg(e) AS e FROM m GROUP BY epoch)
SELECT CAST((SELECT epoch FROM a ORDER BY e, epoch LIMIT 1) AS BIGINT) AS best_epoch, {rounded("(SELECT min(e) FROM a)", 4)} AS best_error"""
)
def leave_one_out_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).alias("fold"), (F.col("l_suppkey") % 7).alias("epoch"), (F.col("l_discount") * 100).alias("error"))
    out = A.fold_error(x, "fold", "epoch", "error")
    return out.select(F.col("best_epoch").cast("long").alias("best_epoch"), r(F.col("best_error"), 4).alias("best_error"))


@query("WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(i // 10 AS BIGINT) AS batch FROM n")
def batched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return L.batches(x, "o_orderkey", free_bytes=1_000_000_000, group=["o_custkey"]).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("SELECT n_regionkey, substr(sha256(array_to_string(list_sort(list(n_name)), ',')), 1, 6) AS digest, count(*) AS total FROM nation GROUP BY n_regionkey")
def schema_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region stand for the columns of a schema."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"), F.count("*").alias("total"))
    return names.select("n_regionkey", schema_hash(F.col("names")).alias("digest"), "total")
