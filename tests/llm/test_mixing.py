"""Systematic mixing against exact fractions, and odd rows."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reverie.llm.mixing import emitted, mix

#: More columns, of the names that the operator works with.
DOCS = StructType([StructField(n, LongType() if n in ("doc_id", "place", "rate") else StringType()) for n in ("doc_id", "text", "source", "size", "place", "rate", "target", "__part")])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2, "y", "z") for i, t, s in rows], DOCS)


def wanted(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, rest = {}, Fraction(share) * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if level * weight[s] > most * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in left}
        for s in over:
            full[s] = Fraction(most * sizes[s])
            rest -= full[s]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 30, 31, 400])) if i % 17 else None, rng.choice(["b", "b", "b", "a", "é", "Z", "", None, "one"])) for i in range(600)]
    out += [(7, "same row", "b")] * 5 + [(None, "no id", "b"), (None, None, None), (900, "\x0b long\ttext " * 20_000, "long")]
    return [r for r in out if r[2] != "one"] + [(901, "a b c", "one")]


def test_mix_meets_targets(spark, rows):
    docs = frame(spark, rows).repartition(5)
    got = mix(docs, keep=("text",)).collect()
    assert Counter((r["doc_id"], r["kept"]["text"], r["source"]) for r in got) == Counter(rows)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["kept"]["text"] or "").split()) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = wanted(sizes, (3, 1, 2), 1.5, 2)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mix(docs.repartition(2), keep=("text",)).collect()
    assert Counter((r["doc_id"], r["size"], r["copies"]) for r in got) == Counter((r["doc_id"], r["size"], r["copies"]) for r in again)
    one, two = (Counter((r["doc_id"], r["copies"]) for r in mix(docs, share=0.01, seed=seed).collect()) for seed in (0, 1))
    assert one != two
    assert emitted(mix(docs)).count() == sum(r["copies"] for r in got)


def test_copies_are_boundaries_of_exact_sums(spark):
    docs = frame(spark, [(i, "a b", "s") for i in range(1000)] + [(i, "c", "t") for i in range(1000, 1500)])
    got = sorted(mix(docs, weights=(1, 5), share=0.7, most=3.0).where("source = 's'").collect(), key=lambda r: r["doc_id"])
    rate, sums = got[0]["target"] / got[0]["source_size"], 0
    for i, r in enumerate(got):
        sums += r["copies"]
        assert abs(sums - rate * (i + 1)) < 1 + 1e-9


def test_odd_tables(spark):
    assert mix(frame(spark, [])).collect() == []
    assert [(r["size"], r["target"], r["taken"]) for r in mix(frame(spark, [(1, None, None), (2, " \n", None)])).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mix(frame(spark, []), weights=(1, 0))
