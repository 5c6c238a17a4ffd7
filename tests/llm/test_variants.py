"""Spelling variants against all pairs of words, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.llm.variants import counted, group_variants, keys_of, without, word_runs

SCHEMA = "word string, n long, place long, form string, root string, best string, up string"


def frame(spark, words):
    return spark.createDataFrame([(w, n, 1, "f", "r", "b", "u") for w, n in words.items()], SCHEMA)


def cuts(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return a in cuts(b) or b in cuts(a)


def brute(words, ratio=2):
    out, form = [], {}
    for w, n in words.items():
        met = sorted((-m, v) for v, m in words.items() if near(v, w))
        form[w] = met[0][1] if met and -met[0][0] >= ratio * n else None
        out.append((w, form[w], n, len(met), words[form[w]] if form[w] else None))

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, f, root(w), n, k, m) for w, f, n, k, m in out)


def found(df, **kw):
    return sorted(tuple(r) for r in group_variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect())


def ordered(rows):
    return sorted(rows, key=lambda r: r[0])


def test_equals_all_pairs(spark):
    rng = random.Random(2)
    words = {}
    for _ in range(30):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
        for _ in range(12):
            words[w] = rng.choice([3, 3, 5, 6, 12, 24, 48, 100, 1000])
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice("abcÿ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i + 1 :]]) or "a"
    words |= {"aaaaa": 5, "aaaaaa": 10, "aaaaaaa": 20, "😀bcde": 7, "bcde": 14, "": 3}
    assert ordered(found(frame(spark, words).repartition(3))) == ordered(brute(words))
    assert ordered(found(frame(spark, words), ratio=1.5)) == ordered(brute(words, 1.5))


def test_long_words_and_many_variants(spark):
    long = "xyz" * 40_000
    words = {long: 50, long[:60_000] + long[60_001:]: 3, long[:-1] + "q": 7, "hub" * 3: 10_000}
    words |= {"hub" * k + x + "hub" * (3 - k): 1 for k in range(4) for x in "acdefghijklmnopqrstvwxyz"}
    got = {r[0]: r[1:] for r in found(frame(spark, words))}
    assert got[long] == (None, long, 50, 2, None) and got[long[:-1] + "q"] == (long, long, 7, 1, 50)
    assert got["hubhubhub"][3] == 96 and sum(r[1] == "hubhubhub" for r in got.values()) == 97


def test_chains_end_at_their_last_form(spark):
    words = {"abcdefghij"[: 2 + i]: 3 * 2**i for i in range(9)}
    assert {r[2] for r in found(frame(spark, words))} == {"abcdefghij"}


def test_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 4, 1, "f", "r", "b", "u"), ("abcde", None, 1, "f", "r", "b", "u")], SCHEMA)) == [("abcde", None, "abcde", 0, 0, None)]
    with pytest.raises(ValueError):
        found(frame(spark, {"a": 1}), ratio=1)


def test_keys_are_equal_only_for_equal_strings():
    words = ["abcab", "abab", "aabab", "zz", "ab", "abcabz" * 50]
    seen = {}
    for of, kind, a, b in zip(*(x.tolist() for x in keys_of(words))):
        seen.setdefault((a, b), set()).add((of, kind))
    strings = {}
    for i, w in enumerate(words):
        for s, kind in [(w, 1), *((w[:p] + "*" + w[p + 1 :], 0) for p in range(len(w))), *((c, 2) for c in cuts(w))]:
            strings.setdefault(s, set()).add((i, kind))
    assert sorted(map(sorted, seen.values())) == sorted(map(sorted, strings.values())) and len(seen) == len(strings)
    assert all(x.dtype == np.int64 for x in keys_of([])[2:])


def test_runs_and_counts(spark):
    texts = ["Élan élan ELAN_elan", None, "", "×a÷b ÀÿZ", "x" * 300_000 + " " + "Ab cD"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(word_runs(F.col("t"))).collect()]
    assert got == [["Élan", "élan", "elan", "elan"], None, [], ["×a÷b", "Àÿz"], ["x" * 300_000, "ab", "cd"]]
    words = spark.createDataFrame([("abcde",)] * 3 + [("abcd",)] * 9 + [("fghij",)] * 2 + [(None,)] * 5, "word string")
    assert counted(words).collect() == [("abcde", 3)]
    assert spark.range(1).select(without(F.lit("abc"), F.lit(0)), without(F.lit("abc"), F.lit(2)), without(F.lit("a"), F.lit(0))).first()[:] == ("bc", "ab", "")
