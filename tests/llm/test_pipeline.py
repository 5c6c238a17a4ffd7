"""Each stage of the pipeline on a small corpus with planted cases and odd rows."""

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

RNG = random.Random(9)
VOCABULARY = ["".join(RNG.choices("abcdefghilmnoprstuv", k=RNG.randint(3, 8))) for _ in range(600)]
BAD = ["grubwit", "snotface", "dunghead"]


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    item = prose(40)
    base = prose(400)
    texts = [prose(RNG.randint(60, 120)) for _ in range(120)]
    for i in range(0, 120, 5):
        texts[i] = texts[i] + " " + RNG.choice(BAD)
    planted = {
        500: base,
        501: base,
        502: base + " tail",
        503: prose(50) + " " + item + " " + prose(20),
        504: prose(30) + " password = 'hunter2hunter2' " + prose(10),
        505: None,
        506: "",
        507: prose(20_000),
        508: "y o " + prose(30) + " grub-wit",
    }
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(i, t, None, None, len(t or "")) for i, t in planted.items()]
    rows += [rows[1], (None, "no id here", None, None, None), (None, "no id here", None, None, None)]
    rows += [(None, prose(50) + " " + item, None, None, None), (504, prose(30) + " " + item, None, None, None), (501, prose(80), None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key_id", "key_hash", "text_hash", "kept", "row", "key", "clean", "score", "part"):
        d = d.withColumn(name, F.lit("clash"))
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialise(stage(spark, docs, corpus), name)
        assert docs.columns == columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
    clean = {i for i in range(120) if i % 5}
    assert not [i for i in kept["toxicity"] if i is not None and i < 120 and i % 5 == 0] and 508 not in kept["toxicity"]
    assert clean | {500, 501, 502, 503, 504, 505, 506, 507} <= set(kept["toxicity"])
    near = kept["simhash_near_dedup"]
    assert near.count(500) == 1 and 502 not in near and sorted(i for i in near if i in clean) == sorted(clean)
    assert near.count(None) == 2 and (505 in near) != (506 in near)
    assert near.count(501) == 1 and near.count(504) == 2  # the other text of each id
    clear = kept["benchmark_decontamination"]
    assert set(near) - set(clear) == {503} and clear.count(None) == 1 and clear.count(504) == 1
    assert sorted(map(str, kept["secret_scan"])) == sorted(map(str, kept["benchmark_decontamination"]))
    row = docs.where("doc_id = 504").first()
    assert "hunter2" not in row["text"] and "[assign]" in row["text"] and row["n_chars"] == len(row["text"])
    pieces = pipeline.packing(spark, docs, corpus)
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["secret_scan"])


def test_near_copies_of_short_documents(spark, tmp_path):
    """Pairs of similarity 0.8 or more, most of them beyond 6 bits of SimHash."""
    rows = []
    for i in range(30):
        words = prose(90).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:45], "changed", *words[46:88]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()) == list(range(0, 60, 2))


def test_run_and_empty_tables(spark, corpus, tmp_path):
    assert {r["doc_id"] for r in pipeline.run(spark, corpus).collect()} >= {501, 504, 507, None}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
