"""Queries of the training-data operators, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table
from .decontam import contaminated
from .langid import identify_languages, train_language_model
from .mixing import mix
from .negatives import hard_negatives
from .oracles import decontamination_sql, secrets_sql
from .packing import pack
from .secrets import BASE, joined, scan_secrets
from .simhash import near_duplicates
from .sharding import shard_by_bytes
from .tokenfile import read_token_files, write_token_files
from .topk import top_k
from .toxicity import score_toxicity, train_toxicity
from .variants import counted, group_variants, without, word_runs
from .viterbi import count_tokens


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_path(spark, "token-stream")
    files = write_token_files(read_table(spark, sf_dir, "documents"), uri)
    return read_token_files(spark, uri, files)


def _integer_vectors(rows: DataFrame) -> DataFrame:
    """Rows of finite components, as vector in 256ths, rounded down."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.col("embedding").isNotNull() & finite).withColumn("vector", F.transform(x, lambda v: F.floor(v * 256)))


def op7_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _integer_vectors(read_table(spark, sf_dir, "embeddings")).select("vec_id", "vector")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op8_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(_remainder(4) != 2))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(read_table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(word_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    word = F.when(h % 97 == 0, without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return group_variants(counted(runs.select(word.alias("word"))))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _integer_vectors(read_table(spark, sf_dir, "embeddings")).select("vec_id", label.alias("label"), "vector")
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: CRC-32 by its bitwise rule: a table of 256 remainders, then a fold over the bytes of the text.
OP10_SQL = """
WITH remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, size, h, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS byte_start, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT doc_id, size, h, CAST(least(23, ((2 * byte_start + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM summed
)
SELECT doc_id, size,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut, remainders
"""


#: CRC-32 of distinct (document, run) as in OP10_SQL; words meet by a wildcard or a deletion of either.
OP11_SQL = """
WITH RECURSIVE remainders AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT run, times, length(run) AS size, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, times, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS h
  FROM bytes, remainders
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % size AS BIGINT)) || substr(run, CAST(h % size + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM hashed GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v
), wild AS (
  SELECT word, n, left(word, p - 1) || '*' || substr(word, p + 1) AS k FROM places
), dels AS (
  SELECT DISTINCT word, n, left(word, p - 1) || substr(word, p + 1) AS k FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT d.word, v.word, v.n FROM dels d JOIN v ON v.word = d.k
  UNION ALL SELECT v.word, d.word, d.n FROM dels d JOIN v ON v.word = d.k
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, {'n': -other_n, 'w': encode(other)}) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN b.other_n >= 2 * v.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * v.n THEN b.other_n END AS form_n
  FROM v LEFT JOIN best b ON v.word = b.word
), followed AS (
  SELECT word, word AS root, form AS up FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM followed w JOIN formed f ON f.word = w.up
)
SELECT f.word, f.form, w.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN followed w ON f.word = w.word AND w.up IS NULL
"""

#: A source is at its limit if the level that is left once all of lower limit by weight are at theirs reaches its own.
OP12_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS budget FROM s
), f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) >= ratio AS capped
  FROM o WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target,
    CAST('0x' || substr(md5('0:' || coalesce('s' || source, 'n')), 1, 12) AS HUGEINT) AS off
  FROM f
), p AS (
  SELECT d.doc_id, d.size, r.source_size, CAST(r.target AS DOUBLE) AS target, r.off,
    CAST(coalesce(floor(r.target / nullif(r.source_size, 0) * 281474976710656), 0) AS HUGEINT) AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS nth
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  CAST(((nth + 1) * rate + off) // 281474976710656 - (nth * rate + off) // 281474976710656 AS BIGINT) * size AS taken
FROM p
"""


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hierarchical_packing, op2_benchmark_decontamination, op3_secret_scan, op4_toxicity_string_kernel, op5_simhash_components, op6_arrow_token_files, op7_kdtree_topk, op8_viterbi_token_counts, op9_language_id, op10_byte_shards, op11_spelling_variants, op12_source_mix, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": decontamination_sql(),
        "op3_secret_scan": secrets_sql(),
        "op7_kdtree_topk": OP7_SQL,
        "op10_byte_shards": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_source_mix": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
