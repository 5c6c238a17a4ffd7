"""Providers: models behind a table-in, table-out contract, run where the data is."""

from __future__ import annotations

import json
import shutil
import traceback
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

#: Answers to a frame of requests at an attempt, and the places of the requests that got no valid one.
Serve = Callable[[pd.DataFrame, int], tuple[pd.DataFrame, list[int]]]


class Provider(Protocol):
    """Turns a batch of requests into observation rows. Made once in each worker, so a model loads once."""

    schema: str

    def __call__(self, requests: pd.DataFrame) -> pd.DataFrame: ...


FAILURE = "struct<attempts: int, error: string, traceback: string, neutral: boolean>"


def _settled(serve: Serve, batch: pd.DataFrame, retries: int) -> Iterator[tuple[pd.DataFrame, int, str | None, str | None]]:
    """(answers, 0, None, None), or (one request, attempts, error, traceback) for a request that fails to the end.

    A call that raises is halved until the request that makes it raise stands alone, so the others are answered in few more
    calls; requests that stand alone, or whose answers were not valid, are asked again up to retries times in all.
    """
    todo = [(batch, 1)]
    while todo:
        part, attempt = todo.pop()
        try:
            rows, left = serve(part, attempt)
            why, trace = "no valid answer", None
        except Exception as e:  # noqa: BLE001  a model may fail in any way
            if len(part) > 1:
                middle = len(part) // 2
                todo += [(part.iloc[middle:], attempt), (part.iloc[:middle], attempt)]
                continue
            rows, left, why, trace = None, [0], f"{type(e).__name__}: {e}", traceback.format_exc()
        if rows is not None and len(rows):
            yield rows, 0, None, None
        if left and attempt < retries:
            todo.append((part.iloc[left], attempt + 1))
        else:
            for i in left:
                yield part.iloc[[i]], attempt, why, trace


def observe(requests: DataFrame, make: Callable[[], Provider], schema: str, retries: int = 3, neutral: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Observation rows of every request, with the column failure. Filters belong before this: Spark does not push them through it.

    One bad request costs no other its answer (see _settled). After the last try it gets the rows that neutral makes of it (a frame
    of one request), or without neutral a row of its own columns that are in schema and nulls; those rows alone have a
    failure: attempts, error, traceback, and whether they are neutral rows. split parts them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        serve = getattr(provider, "serve", None) or (lambda part, attempt: (provider(part), []))
        for batch in batches:
            for rows, attempts, error, trace in _settled(serve, batch, retries):
                failed = error is not None
                if failed:
                    rows = neutral(rows) if neutral else pd.DataFrame({c: rows[c].to_numpy(object) if c in rows else [None] for c in names})
                failure = {"attempts": attempts, "error": error, "traceback": trace, "neutral": neutral is not None} if failed else None
                yield rows[names].assign(failure=[failure] * len(rows))

    names = requests.sparkSession.createDataFrame([], schema).columns
    return requests.mapInPandas(run, f"{schema}, failure {FAILURE}")


def split(observed: DataFrame, key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """(answers with the neutral rows, one error row for each failed request: video_id, attempts, error, traceback) of what observe gave.

    observed is read twice, so it should have been written first.
    """
    failed = F.col("failure").isNotNull()
    answers = observed.where(~failed | F.coalesce(F.col("failure.neutral"), F.lit(False))).drop("failure")
    return answers, observed.where(failed).select(F.col(key).cast("string").alias("video_id"), "failure.attempts", "failure.error", "failure.traceback")


class Asked:
    """A provider of answers in text, each of which must hold what parse finds in it (a dict of columns, or None).

    ask takes a frame of requests and the number of the attempt, and returns a text for each; requests whose text does not hold
    are asked again, they alone.
    """

    def __init__(self, ask: Callable[[pd.DataFrame, int], list[str]], parse: Callable[[str], dict | None], keep: list[str]):
        self.ask, self.parse, self.keep = ask, parse, keep

    def serve(self, requests: pd.DataFrame, attempt: int) -> tuple[pd.DataFrame, list[int]]:
        found = [self.parse(text) for text in self.ask(requests, attempt)]
        good = [i for i, x in enumerate(found) if x is not None]
        rows = requests.iloc[good][self.keep].reset_index(drop=True)
        return pd.concat([rows, pd.DataFrame([found[i] for i in good])], axis=1), [i for i, x in enumerate(found) if x is None]


def parsed_expectations(text: str) -> dict | None:
    """The three lists of a model's JSON answer, single strings as lists; None unless all three are there."""
    try:
        answer = json.loads(text)
        lists = {name: [answer[name]] if isinstance(answer[name], str) else answer[name] for name in C.DEFAULT_EXPECTATIONS}
    except (ValueError, KeyError, TypeError):
        return None
    return lists if all(isinstance(x, list) and all(isinstance(y, str) for y in x) for x in lists.values()) else None


def parsed_direction(text: str) -> dict | None:
    """classified_direction of a model's JSON answer, None unless it is one of the three."""
    try:
        direction = json.loads(text)["classified_direction"]
    except (ValueError, KeyError, TypeError):
        return None
    return {"classified_direction": direction} if direction in ("positive", "negative", "neutral") else None


def default_expectations(keep: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The neutral row of a task whose expectations no model gives: the default lists."""
    return lambda request: pd.concat([request[keep].reset_index(drop=True), pd.DataFrame([C.DEFAULT_EXPECTATIONS])], axis=1)


def direction_by_rule(keep: list[str], emotion: str = "emotion_end") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The neutral row of a transition that no model judges: its direction by the emotion at its end."""

    def rule(x: str) -> str:
        return "positive" if x in C.POSITIVE_EMOTIONS else "negative" if x in C.NEGATIVE_EMOTIONS else "neutral"

    return lambda request: request[keep].assign(classified_direction=[rule(x) for x in request[emotion]])


def silent(request: pd.DataFrame) -> pd.DataFrame:
    """The neutral row of a task whose audio no model hears: nulls, which the prosody layer reads as neutral."""
    return request[["video_id", "task_id"]].assign(max_dbfs=None, pitch_var=None, scores=None, sv_text=None)


class MockEmotions:
    """A deterministic source for tests: calm at first, then unsure, then a reaction; drawn from a seed of the box."""

    schema = "video_id string, task_id string, person_id long, t double, emotion string, magnitude double"

    def __call__(self, requests: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in requests.itertuples():
            rng = np.random.default_rng(int(r.x1 + r.y1 + r.x2 + r.y2))
            progress = (r.t - r.win_start) / max(r.win_end - r.win_start, 1e-9)
            choices = ["neutral"] if progress < 0.3 else ["surprise", "neutral", "fear"] if progress < 0.6 else ["joy", "anger", "surprise"]
            rows.append((r.video_id, r.task_id, r.person_id, r.t, str(rng.choice(choices)), float(rng.uniform(0.4, 1.0))))
        return pd.DataFrame(rows, columns=["video_id", "task_id", "person_id", "t", "emotion", "magnitude"])


def valid_audio_window(start: Column, end: Column, n_bytes: Column | None = None) -> Column:
    """Windows of positive length, and slices longer than a bare header."""
    ok = start.isNotNull() & end.isNotNull() & (start < end)
    return ok if n_bytes is None else ok & (n_bytes > 44)


def valid_expectations(text: Column) -> Column:
    """struct<positive_emotions, negative_emotions, neutral_baseline> of a model's JSON answer, single strings as lists; null unless all three are there."""

    def as_list(name: str) -> Column:
        one = F.get_json_object(text, f"$.{name}")
        many = F.from_json(one, "array<string>")
        return F.when(F.startswith(F.ltrim(one), F.lit("[")), many).when(one.isNotNull(), F.array(one))

    names = ("positive_emotions", "negative_emotions", "neutral_baseline")
    whole = as_list(names[0]).isNotNull()
    for n in names[1:]:
        whole = whole & as_list(n).isNotNull()
    return F.when(whole, F.struct(*(as_list(n).alias(n) for n in names)))


def valid_direction(text: Column) -> Column:
    """The classified direction of a model's JSON answer, null unless it is one of the three."""
    d = F.get_json_object(text, "$.classified_direction")
    return F.when(d.isin("positive", "negative", "neutral"), d)


def enough_disk(path: str, least_gb: float = 10.0) -> bool:
    return shutil.disk_usage(path).free >= least_gb * 1e9
