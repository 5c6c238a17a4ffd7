"""A training-data pipeline of five operators, each stage on what its predecessor kept.

In every stage a decision binds rows, not ids: rows that share a doc_id, or have none, are judged by their own texts. Columns
of documents other than doc_id and text, whatever their names, pass through, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import delete, give_back, materialise, new_path, read_table, temporary
from reverie.llm.decontam import contaminated
from reverie.llm.jaccard import near_copies
from reverie.llm.packing import pack
from reverie.llm.secrets import redact, scan_secrets
from reverie.llm.toxicity import score_toxicity, train_toxicity

#: Keys of dropped rows are broadcast up to this many (16 bytes each), and joined by shuffle beyond.
BROADCAST_KEYS = 1_000_000
#: Near copies are texts whose sets of five-word shingles have at least this Jaccard similarity.
SIMILARITY = 0.8


def _key(docs: DataFrame) -> list[Column]:
    """What tells the rows of documents apart: doc_id and a hash of the text. Rows that agree in both are repeated rows."""
    return [docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))]


def _on(docs: DataFrame, keys: DataFrame) -> Column:
    own = _key(docs)
    return own[0].eqNullSafe(keys["key_id"]) & (own[1] == keys["key_hash"])


def _small(keys: DataFrame, name: str) -> DataFrame:
    keys = materialise(keys.toDF("key_id", "key_hash").distinct(), name)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _roomy(stage: Stage) -> Stage:
    """The stage, before which executors give back what the stage before left in their heaps."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@_roomy
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more. Learns from the labelled rows of the corpus.

    Null and empty texts score lowest and stay. Very long texts are read whole. Rows that tie or repeat score alike, so they go or
    stay together. Without labels of both classes every row has the same score; without any labels all rows stay.
    """
    labels = read_table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = train_toxicity(read_table(spark, sf_dir, "documents"), labels)
    columns = docs.columns
    score, taken = "toxicity", {c.lower() for c in columns}
    while score in taken:
        score += "_"
    scored = score_toxicity(docs, model, tuple(columns)).toDF(*columns, score)
    return scored.where(scored[score] < 0.5).select(*(scored[c] for c in columns))


@_roomy
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of least doc_id, null ids last, then of least text hash.

    SimHash fingerprints find the closer copies; pairs that they miss (about half of those near similarity 0.8) are found
    by an exact join, and whole sets of shingles decide on all of them. Null, empty and blank texts are copies of each
    other, so one of them stays. Of repeated rows one stays. Very long texts are compared whole.
    """
    groups = materialise(near_copies(docs, SIMILARITY), "dedup-groups")
    own = F.struct("doc_id", "text_hash").eqNullSafe(F.col("kept"))
    kept = docs.join(gone := _small(groups.where(~own).select("doc_id", "text_hash"), "dedup-gone"), _on(docs, gone), "left_anti")
    repeated = groups.where(own).groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    twice = _small(repeated, "dedup-repeated")
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, _on(kept, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, _on(kept, twice), "left_anti").unionByName(once)


@_roomy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, also those without a doc_id; null and empty texts hold none and stay.

    Repeated rows go or stay together. Very long texts are searched whole. With no items, all rows stay.
    """
    rows = docs.select(F.xxhash64(*_key(docs)).alias("doc_id"), docs["text"])
    found = materialise(contaminated(rows, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct(), "decontam-found")
    found = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    return docs.join(found, F.xxhash64(*_key(docs)) == found["key"], "left_anti")


@_roomy
def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and puts the kind of each secret in its place; n_chars follows the text. A null text stays null."""
    columns = docs.columns
    found = scan_secrets(docs, keep=tuple(columns))
    text = F.when(F.col("kept")["text"].isNotNull(), redact(F.col("text"), F.col("spans")))
    clean = found.select("kept", text.alias("clean"), (F.size("spans") > 0).alias("hit"))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("kept")["n_chars"]).alias("n_chars"))
        else:
            out.append(F.col("kept")[c].alias(c))
    return clean.select(*out)


@_roomy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row per piece. Null and empty texts are their end id alone; repeated rows are packed each; very long texts are cut, never dropped."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_redaction),
    ("packing", packing),
]
#: Models, near copies and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; the pieces of the last. Each stage is written and read again; tables that are not needed any more are deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
