"""Vectors and votes of language ID against plain loops."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from reverie.llm import langid


def plain_vector(text):
    raw = text.lower().encode("utf-8", "replace")
    counts = Counter()
    for i in range(len(raw) - 1):
        gram = raw[i] << 8 | raw[i + 1]
        for n in (2, 3, 4):
            if i + n > len(raw):
                break
            if n > 2:
                gram = gram * 16777619 % 2**32 ^ raw[i + n - 1]
            counts[(gram * 2654435761 + n * 40503) % 2**32 >> 20] += 1
    x = np.zeros(langid.DIMS)
    for k, c in counts.items():
        x[k] = c**0.5
    return x / max(np.linalg.norm(x), 1e-12)


TEXTS = ["", "a", "ab", "abc", "Ünïcode ﷺ text", "the quick brown fox " * 9, "日本語のテキスト"]


@pytest.mark.parametrize("chunk", [4, 7, 16, 1 << 20])
def test_vector_equals_plain_counts_over_chunk_borders(monkeypatch, chunk):
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    for text in [*TEXTS, *("xyzzy plugh"[:n] * 3 for n in range(1, 12))]:
        assert np.allclose(langid.vector(text), plain_vector(text), atol=1e-12)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(0)
    classes = ["de", "en", "nl", "sv"]
    machines = {(a, b): (rng.normal(size=langid.DIMS), float(rng.normal())) for a, b in combinations(classes, 2)}
    model = langid.LanguageModel(classes, {"all": classes}, machines)
    for _ in range(50):
        x = rng.normal(size=langid.DIMS)
        wins, sums = Counter(), Counter()
        for (a, b), (w, c) in machines.items():
            m = float(x @ w + c)
            wins[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        assert model._vote(x, classes)[0] == min(classes, key=lambda k: (-wins[k], -sums[k], k))


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "text", "x", 1.0)], "doc_id long, text string, lang_pred string, score double")
    model = langid.LanguageModel([], {}, {})
    for c in ("text", "lang_pred", "Score"):
        with pytest.raises(ValueError):
            langid.identify_languages(df, model, keep=("doc_id", c))
    assert [(r["doc_id"], r["lang_pred"]) for r in langid.identify_languages(df, model).collect()] == [(1, "und")]
