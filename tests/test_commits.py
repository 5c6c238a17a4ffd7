"""Versions of result tables: a writer may stop anywhere, and a reader sees whole tables."""

import pytest
from pyspark.sql import functions as F

from reverie.sources import commits
from reverie.sources.commits import ConflictError, Versions, append_results, commit_run, pending, read_results


class Stop(Exception):
    pass


def ids(df):
    return sorted((r["video_id"], r["n"]) for r in df.collect())


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "video_id string, n long")


STEPS = ["write_part", "commit", "_publish"]


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_stop_between_any_two_steps_leaves_a_whole_table(spark, tmp_path, monkeypatch, step, force, after):
    path = str(tmp_path / "r")
    append_results(spark, rows(spark, ("a", 1), ("b", 2)), path)
    real = getattr(Versions, step)

    def stopping(self, *args):
        if after:
            real(self, *args)
        raise Stop

    monkeypatch.setattr(Versions, step, stopping)
    with pytest.raises(Stop):
        append_results(spark, rows(spark, ("b", 20), ("c", 3)), path, force=force)
    monkeypatch.undo()
    new = [("a", 1), ("b", 20), ("c", 3)] if force else [("a", 1), ("b", 2), ("c", 3)]
    committed = after and step in ("commit", "_publish")
    assert ids(read_results(spark, path)) == (new if committed else [("a", 1), ("b", 2)])
    append_results(spark, rows(spark, ("b", 20), ("c", 3)), path, force=force)
    assert ids(read_results(spark, path)) == new
    Versions(spark, path).vacuum()
    assert ids(read_results(spark, path)) == new
    listed = {p for ps in Versions(spark, path).latest()[1].values() for p in ps}
    assert {p.name for p in (tmp_path / "r").iterdir()} == listed | {"_versions"}


def test_a_write_in_between_is_noticed(spark, tmp_path):
    path = str(tmp_path / "r")
    append_results(spark, rows(spark, ("a", 1)), path)
    one, two = Versions(spark, path), Versions(spark, path)
    base, parts = one.latest()
    mine, other = one.write_part(rows(spark, ("b", 2)), "results"), two.write_part(rows(spark, ("c", 3)), "results")
    two.commit(base, parts | {"results": [*parts["results"], other]})
    with pytest.raises(ConflictError):
        one.commit(base, parts | {"results": [*parts["results"], mine]})
    assert ids(read_results(spark, path)) == [("a", 1), ("c", 3)] and one.latest()[0] == base + 1


def test_runs_retry_what_they_must(spark, tmp_path):
    every = rows(spark, ("done", 0), ("skip", 0), ("nothing", 0), ("raise", 0))
    errors = spark.createDataFrame([("raise", "boom", "trace")], "video_id string, error string, traceback string")
    records = spark.createDataFrame([("done", None), ("skip", "no_pose_data")], "video_id string, skipped_reason string")
    for layer, left in (("03a_attention", ["nothing", "raise", "skip"]), ("03f_motor_resonance", ["nothing", "raise"])):
        path = str(tmp_path / layer)
        assert pending(spark, every, layer, path).count() == 4
        for attempt in (1, 2):
            asked = pending(spark, every, layer, path)
            assert commit_run(spark, layer, path, asked, records.join(asked, "video_id", "left_semi"), errors) == attempt
            assert sorted(r[0] for r in pending(spark, every, layer, path).collect()) == left
        ledger = Versions(spark, path).read("ledger")
        assert {(r["video_id"], r["attempt"]): (r["outcome"], r["error"]) for r in ledger.where("video_id in ('raise', 'done')").collect()} == {("raise", 1): ("raised", "boom"), ("raise", 2): ("raised", "boom"), ("done", 1): ("done", None)}
        assert pending(spark, every, layer, path, attempts=2).count() == 0 and pending(spark, every, layer, path, force=True).count() == 4
        assert sorted(r["video_id"] for r in read_results(spark, path).collect()) == (["done"] if layer in commits.RETRIED else ["done", "skip"])
    assert read_results(spark, str(tmp_path / "none")) is None and Versions(spark, str(tmp_path / "none")).read("ledger", commits.LEDGER).count() == 0


def test_a_recording_that_raised_has_no_record(spark, tmp_path):
    path = str(tmp_path / "r")
    errors = spark.createDataFrame([("a", "boom", "t")], "video_id string, error string, traceback string")
    commit_run(spark, "03g_shared_reality", path, rows(spark, ("a", 1)), rows(spark, ("a", 1)), errors)
    assert read_results(spark, path).count() == 0
    commit_run(spark, "03g_shared_reality", path, rows(spark, ("a", 1)), rows(spark, ("a", 1)))
    assert ids(read_results(spark, path)) == [("a", 1)] and Versions(spark, path).read("ledger").agg(F.max("attempt")).first()[0] == 2
