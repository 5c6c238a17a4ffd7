"""One bad request costs no other its answer."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reverie.plans import layers
from reverie.sources import providers
from reverie.sources.shared import stored

BAD = (17, 4_999, 9_999)


AUDIO = "video_id string, task_id string, max_dbfs double, pitch_var double, scores map<string,double>, sv_text string"


@pytest.mark.parametrize("neutral", [providers.silent, None])
def test_quarantine(spark, neutral):
    bad = BAD

    class Loud:
        """Hears every request but some, for which the whole call fails."""

        def __call__(self, requests):
            if requests["n"].isin(bad).any():
                raise ValueError("no sound")
            return pd.DataFrame({"video_id": requests["video_id"], "task_id": requests["task_id"], "max_dbfs": -10.0, "pitch_var": 0.0, "scores": [{"angry": 1.0}] * len(requests), "sv_text": ""})

    requests = spark.range(10_000).select(F.col("id").cast("string").alias("video_id"), F.lit("t_00").alias("task_id"), F.col("id").alias("n")).coalesce(1)
    observed, _ = stored(providers.observe(requests, Loud, AUDIO, neutral=neutral), "heard")
    answers, errors = providers.split(observed)
    heard = answers.where("max_dbfs is not null")
    assert heard.count() == 9_997 and heard.select("video_id").distinct().count() == 9_997
    assert sorted((r["video_id"], r["attempts"], r["error"]) for r in errors.collect()) == sorted((str(n), 3, "ValueError: no sound") for n in BAD)
    assert all("no sound" in r["traceback"] for r in errors.collect())
    quiet = answers.where("max_dbfs is null")
    assert sorted(r["video_id"] for r in quiet.collect()) == (sorted(map(str, BAD)) if neutral else [])
    if neutral:
        assert {(r["classified_acoustic_tone"], r["prosody_scalar"], r["max_dbfs"]) for r in layers.prosody(quiet).collect()} == {("Neutral", 0.0, -100.0)}


def test_calls_stay_few():
    calls = []

    def serve(part, attempt):
        calls.append(len(part))
        if (part["n"] == 700).any():
            raise RuntimeError
        return part, []

    out = list(providers._settled(serve, pd.DataFrame({"n": range(1024)}), 3))
    assert sum(len(rows) for rows, *_, error, _ in out if error is None) == 1023 and len(calls) <= 2 * 10 + 3


def test_text_answers(spark):
    asked = []

    def ask(requests, attempt):
        asked.append((attempt, sorted(requests["task_label"])))
        good = '{"positive_emotions": "joy", "negative_emotions": ["fear"], "neutral_baseline": []}'
        return [good if label == "Cook" or (label == "Paint" and attempt == 2) else '{"positive_emotions": 3}' for label in requests["task_label"]]

    frame = pd.DataFrame({"video_id": ["a", "b", "c"], "task_label": ["Cook", "Paint", "Mumble"]})
    provider = providers.Asked(ask, providers.parsed_expectations, ["video_id"])
    out = list(providers._settled(provider.serve, frame, 3))
    assert asked == [(1, ["Cook", "Mumble", "Paint"]), (2, ["Mumble", "Paint"]), (3, ["Mumble"])]
    assert [(list(rows["video_id"]), n, error) for rows, n, error, _ in out] == [(["a"], 0, None), (["b"], 0, None), (["c"], 3, "no valid answer")]
    assert out[0][0]["positive_emotions"][0] == ["joy"]
    schema = "video_id string, positive_emotions array<string>, negative_emotions array<string>, neutral_baseline array<string>"

    class Dumb:
        def serve(self, requests, attempt):
            return requests.iloc[:0], list(range(len(requests)))

    got = providers.observe(spark.createDataFrame(frame), Dumb, schema, neutral=providers.default_expectations(["video_id"])).collect()
    assert {r["video_id"] for r in got} == {"a", "b", "c"} and all(r["neutral_baseline"] == ["neutral", "surprise"] and r["failure"]["neutral"] for r in got)
    rule = providers.direction_by_rule(["video_id"])(pd.DataFrame({"video_id": ["a", "b", "c"], "emotion_end": ["joy", "fear", "surprise"]}))
    assert list(rule["classified_direction"]) == ["positive", "negative", "neutral"]
    for text in ("", "[]", "{}", '{"classified_direction": "up"}', "null"):
        assert providers.parsed_direction(text) is None and providers.parsed_expectations(text) is None
    assert providers.parsed_direction(json.dumps({"classified_direction": "neutral"})) == {"classified_direction": "neutral"}
