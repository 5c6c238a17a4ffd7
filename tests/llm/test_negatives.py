"""Hard negatives against all pairs, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverie.llm.negatives import _Anchor, _Index, _Lists, hard_negatives, kmeans

SCHEMA = "vec_id long, label int, vector array<long>, score string, cluster string, `group` string, windows string, window string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=3, low=50, high=95):
    rows = [(i, str(lab), tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v]
    rows = list(dict.fromkeys(rows))
    out = []
    for i, label, v in rows:
        if i % 10:
            continue
        met = sorted((-int(np.dot(v, w)), j, lab) for j, lab, w in rows if j != i and len(w) == len(v))
        for p, j, _ in [m for m in met if m[2] == label][:positives]:
            inside = [m for m in met if m[2] != label and low * -p <= 100 * -m[0] <= high * -p][:negatives]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect())


def vectors(n, seed=1, spread=20):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (8, 6))
    return [(int(i), int(rng.integers(0, 4)), (centres[rng.integers(0, 8)] + rng.integers(-spread, spread + 1, 6)).tolist()) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"clusters": 8, "group_rows": 16}, {"clusters": 1, "group_rows": 1000}, {"clusters": 40, "sample_rows": 50, "group_rows": 7, "positives": 2, "negatives": 1, "low_percent": 20, "high_percent": 100}])
def test_equals_all_pairs(spark, kw):
    rows = vectors(300)
    rows += [(1000 + i, i % 3, [7, 7, 7, 7, 7, 7]) for i in range(120)]  # equal vectors: ties, and a cluster that is split
    rows += rows[:40]  # repeated rows
    rows += [(20, 2, [1, 2, 3, 4, 5, 6]), (50, 0, [1, 2]), (2001, 0, [3, 4]), (2002, 1, [2, 3]), (60, 1, []), (2003, 1, []), (2004, 2, []), (None, 1, [1] * 6), (70, None, [1] * 6), (80, 1, None), (90, 1, [1, None, 1, 1, 1, 1])]
    got = mined(frame(spark, rows).repartition(4), **kw)
    args = {k: v for k, v in kw.items() if k in ("positives", "negatives")} | {"low": kw.get("low_percent", 50), "high": kw.get("high_percent", 95)}
    assert got == brute(rows, **args) and got


def test_odd_tables(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(10, 1, [1, 2])])) == []
    with pytest.raises(OverflowError):
        mined(frame(spark, [(10, 1, [1 << 40, 2]), (11, 1, [1, 2])]))


def test_clusters_out_of_the_window_are_not_read():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.array([c, 1000 - c]) + rng.integers(-5, 6, (50, 2)) for c in range(0, 1000, 100)]).astype(float)
    centres = kmeans(x, 10)
    import pyarrow as pa

    near = np.argmin(((x[:, None] - centres) ** 2).sum(2), 1)
    radii = np.array([np.sqrt(((x[near == c] - centres[c]) ** 2).sum(1)).max(initial=0) for c in range(len(centres))] + [0.0] * 16)
    index = _Index(2, centres, radii, np.zeros(len(radii), int), np.ones(len(radii), int))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(["n"] * len(x)), pa.array(x.astype(int).tolist(), pa.list_(pa.int64())), pa.array(near.astype(np.int32))], names=["vec_id", "label", "vector", "cluster"])
    lists, q = _Lists(index, [batch]), np.array([10.0, 0.0])
    low, high = index.bounds(q[None])
    scores = x @ q
    for c in np.unique(near).tolist():
        assert low[0, c] <= scores[near == c].min() and scores[near == c].max() <= high[0, c]

    class Read(np.ndarray):
        rows = 0

        def __matmul__(self, other):
            Read.rows += len(self)
            return np.asarray(self) @ other

    ids, codes, rows, held, starts = lists.of[2]
    lists.of[2] = (ids, codes, rows.view(Read), held, starts)
    (score, found), = _Anchor(-1, "a", False, [(4000.0, 5900.0)]).search(lists, q, low[0], high[0], 3)
    want = sorted(((-s, i) for i, s in enumerate(scores) if 4000 <= s <= 5900))[:3]
    assert list(zip((-score).tolist(), found.tolist())) == want and Read.rows <= 150
