"""Sources, sinks, export and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reverie.operators.joins import unprocessed
from reverie.plans.export import base_rows, wide_rows
from reverie.sources import commits, readers, sinks
from reverie.streaming import incremental

MANIFEST = "id string, video_id string, source_dataset string, duration_sec double, fps double, identified_tasks array<struct<task_id:string,task_label:string>>"


@pytest.fixture()
def manifest(tmp_path, spark):
    rows = [
        {"video_id": "v1", "source_dataset": "ego4d", "duration_sec": 9.0, "fps": 30.0, "identified_tasks": [{"task_label": "Cooking"}, {"task_label": "Stirring"}]},
        {"id": "v2", "duration_sec": 5.0, "fps": 30.0, "identified_tasks": [{"task_label": "Cleaning"}]},
        {"video_id": "", "fps": 1.0, "identified_tasks": []},
    ]
    (tmp_path / "manifest.json").write_text(json.dumps(rows))
    return readers.read_documents(spark, str(tmp_path / "manifest.json"), MANIFEST)


def test_export_round_trip(spark, manifest, tmp_path):
    base = {r["video_id"]: r for r in base_rows(manifest).collect()}
    assert set(base) == {"v1", "v2"} and base["v1"]["task_labels"] == "Cooking, Stirring" and base["v2"]["source_dataset"] == "Unknown"
    layers = tmp_path / "layers"
    layers.mkdir()
    (layers / "03a_attention_result.json").write_text(json.dumps([{"video_id": "v1", "layer": "03a", "processing_meta": {"model_used": "m", "x": {"y": 1}}, "per_person": [{"person_id": 1}, {"person_id": 2}], "aggregate": {"num_bystanders_tracked": 2}}]))
    (layers / "03b_reasonable_emotion_result.json").write_text(json.dumps([{"video_id": "v3", "tasks_analyzed": [{"task_aggregate_score": 0.75}, {"task_aggregate_score": 0.5}]}, {"layer": "no id"}]))
    (layers / "03z_fake_result.json").write_text("{broken")
    found = readers.read_layers(spark, str(layers))
    assert list(found) == ["03a_attention", "03b_reasonable_emotion"]
    wide = wide_rows(manifest, found)
    rows = {r["video_id"]: r for r in wide.collect()}
    assert set(rows) == {"v1", "v2", "v3"}
    assert rows["v1"]["03a_attention_num_bystanders_tracked"] == 2 and rows["v1"]["03a_attention_processing_meta_model_used"] == "m" and rows["v2"]["03a_attention_num_bystanders_tracked"] is None
    assert json.loads(rows["v1"]["03a_attention_processing_meta_x"]) == {"y": 1} and rows["v3"]["03b_reasonable_emotion_avg_task_score"] == 0.625
    out = str(tmp_path / "out")
    side = sinks.export(sinks.with_metadata(wide, list(found)), out, list(found), "abc", single_file=True)
    assert side["total_videos"] == 3 and side["schema_version"].startswith("1.0.0+") and len(side["schema_version"]) == 12
    assert json.loads(spark.read.text(f"{out}_metadata").first()[0])["pipeline_git_sha"] == "abc"
    files = spark.createDataFrame([("/data/v1.mp4",), ("/data/v9.mp4",)], "file_path string")
    again = sinks.rehydrate(spark.read.parquet(out), files)
    assert {r["video_id"]: r["n_persons"] for r in again.collect()}["v1"] == 2
    assert tuple(sinks.match_counts(again).first()) == (1, 2, 3)
    assert sinks.inflation(wide, None)[0] is None and sinks.inflation(wide, 100)[0] > 0


def test_validation(spark):
    good = spark.createDataFrame([("a", "see /Users/x")], "video_id string, note string")
    sinks.validate(good)
    with pytest.raises(sinks.LeakError, match="note"):
        sinks.validate(good, strict=True)
    for bad in ("data:image/png;base64,xx", "/Volumes/x", "/tmp/y"):
        with pytest.raises(sinks.LeakError, match="note"):
            sinks.validate(good.withColumn("note", F.lit(bad)))
    with pytest.raises(sinks.LeakError, match="blob"):
        sinks.validate(good.withColumn("blob", F.lit("x").cast("binary")))


def test_validation_reaches_nested_texts(spark):
    kind = "id string, plain array<string>, deep struct<notes: array<struct<`a.b`: string, n: int>>, tags: map<string, array<string>>>, `odd.name` string"
    row = ("x", ["ok", None], ([("fine", 1), None], {"k": ["v", None], "none": None}), None)
    sinks.validate(spark.createDataFrame([row], kind))
    bad = [
        ("x", ["ok", "/tmp/f"], ([("fine", 1)], {"k": ["v"]}), "data:image/png;base64,x"),
        ("x", None, ([("ok", 1), ("/Users/me", 2)], {"/tmp/key": ["v", "/Volumes/x"]}), None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([row, *bad], kind)
    assert sinks.leak_paths(df) == ["plain[]", "deep.notes[].a.b", "deep.tags{key}", "deep.tags{}[]", "odd.name"]
    with pytest.raises(sinks.LeakError, match=r"deep\.tags\{\}\[\]"):
        sinks.validate(df)
    for nested in ("array<binary>", "struct<a: map<string, binary>>", "map<string, array<struct<b: binary>>>"):
        with pytest.raises(sinks.LeakError, match="holds bytes"):
            sinks.validate(spark.createDataFrame([], f"x {nested}"))
    sinks.validate(spark.createDataFrame([], "n int"))


def test_listings(spark, tmp_path):
    for p in ("a/x.mp4", "a/deep/y.mp4", "a/._z.mp4", "b/x.txt", "a/w.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    got = {(r["id"], r["dataset"], r["file_size"]) for r in readers.scan_recordings(spark, {"one": [str(tmp_path / "a/deep")], "two": [str(tmp_path / "a")]}).collect()}
    assert got == {("y", "one", 5), ("x", "two", 5), ("w", "two", 5)}
    (tmp_path / "meta.json").write_text(json.dumps({"videos": [{"video_uid": "u", "n": 1}, {"video_uid": "u", "n": 2}, {"n": 3}]}))
    assert [(r["video_uid"], r["n"]) for r in readers.read_metadata(spark, str(tmp_path / "meta.json")).collect()] == [("u", 2)]
    (tmp_path / "list.json").write_text(json.dumps([{"video_uid": "p"}, {"x": 1}]))
    assert [r[0] for r in readers.read_uids(spark, str(tmp_path / "list.json")).collect()] == ["p"]
    (tmp_path / "ids.csv").write_text("video_id,x\nb,1\na,2\nb,3\n")
    assert [r[0] for r in readers.read_csv_ids(spark, str(tmp_path / "ids.csv")).collect()] == ["b", "a"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.mp4", "x")
        z.writestr("two.txt", "x")
    assert [r["id"] for r in readers.zip_members(spark, str(tmp_path / "z.zip")).collect()] == ["one"]


def test_a_large_archive_is_listed_by_its_directory(spark, tmp_path, monkeypatch):
    class Sparse(io.FileIO):
        """Leaves holes for zeros."""

        def write(self, data):
            if len(data) > 4096 and not any(data[:64]):
                self.seek(len(data), io.SEEK_CUR)
                return len(data)
            return super().write(data)

    path = tmp_path / "large.zip"
    with Sparse(path, "w") as f, zipfile.ZipFile(f, "w", allowZip64=True) as z:
        with z.open("clips/big.mp4", "w", force_zip64=True) as big:
            for _ in range(66):
                big.write(bytes(64 << 20))
        for i in range(200):
            z.writestr(f"clips/{i}.mp4", b"x" * i)
        z.writestr("notes.txt", b"x")
    assert path.stat().st_size > 4 << 30
    rows = readers.zip_members(spark, str(path))
    got = {r["member"]: (r["id"], r["size"]) for r in rows.collect()}
    assert len(got) == 201 and got["clips/big.mp4"] == ("big", 66 * (64 << 20)) and got["clips/7.mp4"] == ("7", 7)
    read, real = [], readers.open_ranged

    class Counted(io.RawIOBase):
        def __init__(self, f):
            self.f = f

        def readable(self):
            return True

        seekable = readable

        def seek(self, *a):
            return self.f.seek(*a)

        def tell(self):
            return self.f.tell()

        def readinto(self, b):
            x = self.f.read(len(b))
            n = len(x)
            b[:n] = x
            read.append(n)
            return n

    monkeypatch.setattr(readers, "open_ranged", lambda p: Counted(real(p)))
    reader = readers._ZipReader({"paths": json.dumps([str(path)]), "suffix": ".mp4"})
    assert len(list(reader.read(reader.partitions()[0]))) == 201 and sum(read) < 1 << 20


def test_resume_and_ledgers(spark, tmp_path):
    every, done = spark.createDataFrame([("a",), ("b",)], "video_id string"), spark.createDataFrame([("a",), ("a",)], "video_id string")
    assert [r[0] for r in unprocessed(every, done, "video_id").collect()] == ["b"] and unprocessed(every, done, "video_id", force=True).count() == 2
    errors = spark.createDataFrame([("a", "e", "t")], "video_id string, error string, traceback string")
    for _ in range(2):
        sinks.append_errors(errors, str(tmp_path / "errors"))
        commits.append_results(spark, every, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "errors")).count() == 1 and commits.read_results(spark, str(tmp_path / "results")).count() == 2
    more = spark.createDataFrame([("b", 2.0), ("c", 3.0), ("c", 3.0)], "video_id string, score double")
    commits.append_results(spark, more, str(tmp_path / "results"), force=True)
    got = {r["video_id"]: r["score"] for r in commits.read_results(spark, str(tmp_path / "results")).collect()}
    assert got == {"a": None, "b": 2.0, "c": 3.0}
    rows = spark.createDataFrame([("a", None), ("b", "no_pose_data")], "video_id string, skipped_reason string")
    assert commits.recorded(rows, "03a_attention").count() == 1 and commits.recorded(rows, "03f_motor_resonance").count() == 2


def test_incremental_run(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"video_id": "a", "n": 1}\n')
    run = lambda: incremental.run_incrementally(spark, str(source), "video_id string, n long", target, str(tmp_path / "ck"), lambda d: d.where("n > 0"))
    run()
    (source / "2.json").write_text('{"video_id": "b", "n": 2}\n{"video_id": "c", "n": 0}\n')
    run()
    run()
    assert sorted(r["video_id"] for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_burst_stream_equals_batch(spark, tmp_path):
    from reverie.operators.series import burst_sampled

    grid = [("v", p, i / 32, 0.9 if p and 0.5 <= i / 32 < 0.7 else 0.1) for p in (0, 1) for i in range(64)]
    df = spark.createDataFrame(grid, "video_id string, person_id long, t double, score double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = incremental.burst_stream(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["person_id"], r["t"], r["in_burst"]) for r in burst_sampled(df, ["video_id", "person_id"], "t", "score").collect()}
    assert {(r["person_id"], r["t"], r["in_burst"]) for r in spark.table("bursts").collect()} == want


def test_tumbling_counts(spark):
    df = spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["count"] for r in incremental.tumbling_counts(df, "ts", "k").collect()) == [1, 2]


def test_providers(spark):
    from reverie.sources import providers

    requests = spark.createDataFrame([("v", "t", 1, t, 0, 0, 10, 10, 0.0, 1.0) for t in (0.1, 0.5, 0.9)], "video_id string, task_id string, person_id long, t double, x1 int, y1 int, x2 int, y2 int, win_start double, win_end double")
    emotions = lambda: providers.split(providers.observe(requests, providers.MockEmotions, providers.MockEmotions.schema))[0].orderBy("t").collect()
    rows = emotions()
    assert rows[0]["emotion"] == "neutral" and rows[2]["emotion"] in {"joy", "anger", "surprise"} and rows == emotions()

    class Broken:
        schema = "a long"

        def __call__(self, requests):
            raise RuntimeError

    assert providers.split(providers.observe(requests, Broken, "video_id string, a long"))[0].count() == 0
    answers = ['{"positive_emotions": "joy", "negative_emotions": ["a", "b"], "neutral_baseline": []}', '{"positive_emotions": "joy"}', "no json"]
    got = spark.createDataFrame([(a,) for a in answers], "x string").select(providers.valid_expectations(F.col("x")).alias("e")).collect()
    assert got[0]["e"]["positive_emotions"] == ["joy"] and got[0]["e"]["negative_emotions"] == ["a", "b"] and got[1]["e"] is None and got[2]["e"] is None
    dirs = spark.createDataFrame([('{"classified_direction": "positive"}',), ('{"classified_direction": "up"}',)], "x string").select(providers.valid_direction(F.col("x")).alias("d")).collect()
    assert [r["d"] for r in dirs] == ["positive", None]
    w = spark.createDataFrame([(1.0, 2.0, 100), (2.0, 2.0, 100), (1.0, 2.0, 44)], "s double, e double, n int")
    assert w.where(providers.valid_audio_window(F.col("s"), F.col("e"), F.col("n"))).count() == 1
    assert providers.enough_disk("/", 0.0)
