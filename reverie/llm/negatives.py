"""Hard-negative mining by inner product over k-means inverted lists with stored radii."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, released, shuffle_partitions

#: Clusters of vectors whose dimension the sample does not have most often; their centre is the origin.
_OTHERS = 16
#: (anchor, group) rows of an output batch.
_ROWS = 1 << 14
#: Inner products below this are exact in doubles.
_EXACT = 1 << 52


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centres of the rows of x by Lloyd's rounds from k distinct rows."""
    x = np.unique(x.astype(np.float64), axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds if len(centres) < len(x) else 0):
        near = nearest_centre(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each row, its distance)."""
    near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, 1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


@dataclass
class _Index:
    """Centres, and for each cluster its radius, its first group and over how many groups it is split."""

    dim: int
    centres: np.ndarray
    radii: np.ndarray
    base: np.ndarray
    parts: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By Cauchy-Schwarz, the least and greatest inner product with each row of q that a vector of each cluster can have, with room for rounding."""
        norm = np.sqrt((q**2).sum(1))[:, None]
        fitted = len(self.centres)
        middle = np.zeros((len(q), len(self.radii)))
        if q.shape[1] == self.dim:
            middle[:, :fitted] = q @ self.centres.T
        reach = norm * self.radii * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1e-6 + norm * 1e-6
        return middle - reach, middle + reach

    def groups(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) for each true (row, cluster), each once."""
        row, cluster = np.nonzero(wanted)
        n = self.parts[cluster]
        row, cluster = np.repeat(row, n), np.repeat(cluster, n)
        group = self.base[cluster] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.column_stack([row, group]), axis=0)
        return both[:, 0], both[:, 1]


def _by_dimension(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) of each dimension."""
    sizes, starts = np.diff(lists.offsets.to_numpy()), lists.offsets.to_numpy()[:-1]
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def _clusters(dim: int, centres: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    cluster, dist = np.zeros(len(lists), np.int64), np.zeros(len(lists))
    for own, x in _by_dimension(lists):
        if x.shape[1] == dim and len(centres):
            cluster[own], dist[own] = nearest_centre(x, centres)
        else:
            cluster[own], dist[own] = len(centres) + x.shape[1] % _OTHERS, np.sqrt((x**2).sum(1))
    return cluster, dist


_Batches = Iterator[pa.RecordBatch]
_Run = Callable[[_Batches], _Batches]


def _measure(dim: int, centres: np.ndarray) -> _Run:
    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            vectors = batch.column("vector")
            cluster, dist = _clusters(dim, centres, vectors)
            tops = np.zeros(len(vectors))
            for own, x in _by_dimension(vectors):
                tops[own] = (np.abs(x).max(1) * np.sqrt(x.shape[1])) if x.shape[1] else 0
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dist), pa.array(tops)], names=["cluster", "dist", "top"])

    return released(run)


def _deal(index: _Index) -> _Run:
    """Rows with their cluster and group; a cluster that is split deals its rows by a hash of their id."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            cluster, _ = _clusters(index.dim, index.centres, batch.column("vector"))
            ids = batch.column("vec_id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            group = index.base[cluster] + ((ids >> np.uint64(33)).astype(np.int64) % index.parts[cluster])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(group)], names=[*batch.schema.names, "cluster", "group"])

    return released(run)


class _Lists:
    """The inverted lists of one group, or of a part of one: rows by dimension and cluster, repeated rows once."""

    def __init__(self, index: _Index, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        labels = table.column("label").combine_chunks().dictionary_encode()
        self.codes = {x: i for i, x in enumerate(labels.dictionary.to_pylist())}
        ids, codes, clusters = table.column("vec_id").to_numpy(), labels.indices.to_numpy(), table.column("cluster").to_numpy()
        self.index, self.of = index, {}
        for own, x in _by_dimension(table.column("vector").combine_chunks()):
            i, code, cluster = ids[own], codes[own], clusters[own]
            if len(np.unique(i)) < len(i):
                once = np.unique(np.column_stack([i, code, x.astype(np.int64)]), axis=0, return_index=True)[1]
                i, code, cluster, x = i[once], code[once], cluster[once], x[once]
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            self.of[x.shape[1]] = (i[order], code[order], x[order], held, np.append(starts, len(order)))


def _merged(score: np.ndarray, ids: np.ndarray, more: np.ndarray, their: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, ties to the smaller id."""
    if len(more) > 4 * k:
        keep = more >= np.partition(more, -k)[-k]
        more, their = more[keep], their[keep]
    score, ids = np.append(score, more), np.append(ids, their)
    best = np.lexsort((ids, -score))[:k]
    return score[best], ids[best]


_NONE = (np.empty(0), np.empty(0, np.int64))


@dataclass
class _Anchor:
    """An anchor in a group: its own id and label, and the windows of scores (low, high) that it asks for, each with its best so far."""

    vec_id: int
    label: str
    same: bool
    windows: list[tuple[float, float]]

    def search(self, lists: _Lists, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Visits clusters from the greatest upper bound down: skips those whose bounds miss every window, and stops where the bound is strictly below every window's low end and kth score."""
        found = [_NONE] * len(self.windows)
        ids, codes, x, held, starts = lists.of[len(q)]
        code = lists.codes.get(self.label, -1)
        if self.same and code < 0:
            return found
        low, high = low[held], high[held]
        floors = [a for a, _ in self.windows]  # the low end, or the kth score once there are k
        for c in np.argsort(-high).tolist():
            if high[c] < min(floors):
                break
            open_ = [j for j, (_, top) in enumerate(self.windows) if high[c] >= floors[j] and low[c] <= top]
            if not open_:
                continue
            a, b = starts[c], starts[c + 1]
            scores = x[a:b] @ q
            fits = (scores >= min(floors[j] for j in open_)) & ((codes[a:b] == code) == self.same) & (ids[a:b] != self.vec_id)
            if not fits.any():
                continue
            scores, own = scores[fits], ids[a:b][fits]
            for j in open_:
                inside = (scores >= floors[j]) & (scores <= self.windows[j][1])
                if inside.any():
                    found[j] = _merged(*found[j], scores[inside], own[inside], k)
                    if len(found[j][0]) == k:
                        floors[j] = found[j][0][-1]
        return found


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch over which the columns stay the same."""
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in columns:
        x = batch.column(c).to_numpy(zero_copy_only=False)
        changed |= x[1:] != x[:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _home(index: _Index, k: int) -> _Run:
    """For each anchor the kth score among the rows of its label in its own group, null if there are fewer."""

    def of(rows: list[pa.RecordBatch]) -> _Batches:
        asking = [r for b in rows if (r := b.filter(b.column("asks"))).num_rows]
        if not asking:
            return
        lists = _Lists(index, rows)
        for batch in asking:
            floors = np.full(batch.num_rows, np.nan)
            for own, q in _by_dimension(batch.column("vector")):
                low, high = index.bounds(q)
                for at, i in enumerate(own.tolist()):
                    anchor = _Anchor(batch.column("vec_id")[i].as_py(), batch.column("label")[i].as_py(), True, [(-np.inf, np.inf)])
                    score, _ = anchor.search(lists, q[at], low[at], high[at], k)[0]
                    if len(score) == k:
                        floors[i] = score[-1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row_key"), pa.array(floors, from_pandas=True)], names=["anchor_id", "anchor_key", "floor"])

    def run(batches: _Batches) -> _Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in _runs(batch, "group"):
                if held and held[0].column("group")[0] != part.column("group")[0]:
                    yield from of(held)
                    held = []
                held.append(part)
        yield from of(held)

    return released(run)


def _spread(index: _Index) -> _Run:
    """Each anchor once for every group that has a cluster whose bounds meet one of its windows."""

    def run(batches: _Batches) -> _Batches:
        step = max(1, _ROWS // max(1, int(index.parts.sum())))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                wanted = np.zeros((batch.num_rows, len(index.radii)), bool)
                windows = batch.column("windows").to_pylist()
                for own, q in _by_dimension(batch.column("vector")):
                    low, high = index.bounds(q)
                    for i, lo, hi in zip(own.tolist(), low, high):
                        for w in windows[i]:
                            wanted[i] |= (hi >= w["low"]) & (lo <= w["high"])
                rows, groups = index.groups(wanted)
                if len(rows):
                    out = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(groups)], names=[*out.schema.names, "group"])

    return released(run)


def _scan(index: _Index, same: bool, k: int) -> _Run:
    """Rows arrive group by group, lists before anchors: the lists of one group are held, its anchors pass through."""
    names = ["anchor_id", "anchor_key", "window", "vec_id", "score"]

    def answers(lists: _Lists, batch: pa.RecordBatch) -> _Batches:
        ids, keys, labels, windows = (batch.column(c).to_pylist() for c in ("vec_id", "row_key", "label", "windows"))
        rows: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
        for own, q in _by_dimension(batch.column("vector")):
            if q.shape[1] not in lists.of:
                continue
            low, high = index.bounds(q)
            for at, i in enumerate(own.tolist()):
                anchor = _Anchor(ids[i], labels[i], same, [(w["low"], w["high"]) for w in windows[i]])
                for w, (score, found) in zip(windows[i], anchor.search(lists, q[at], low[at], high[at], k)):
                    if len(score):
                        rows.append((ids[i], keys[i], w["window"], found, score))
        if rows:
            n = [len(r[3]) for r in rows]
            head = [pa.array(np.repeat(np.array([r[c] for r in rows], np.int64), n)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.concatenate([r[3] for r in rows])), pa.array(np.concatenate([r[4] for r in rows]).astype(np.int64))], names=names)

    def run(batches: _Batches) -> _Batches:
        held, group, lists = [], None, None
        for batch in batches:
            for part in _runs(batch, "group", "asks"):
                now = part.column("group")[0].as_py()
                if now != group:
                    held, group, lists = [], now, None
                if not part.column("asks")[0].as_py():
                    held.append(part)
                elif held:
                    lists = lists or _Lists(index, held)
                    for at in range(0, part.num_rows, 512):
                        yield from answers(lists, part.slice(at, 512))

    return released(run)


def _index(rows: DataFrame, n: int, clusters: int | None, sample_rows: int, group_rows: int) -> _Index:
    share = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, n // sample_rows))) == 0
    sample = rows.where(share).select("vector").limit(2 * sample_rows).toArrow().combine_chunks()
    by_dim = sorted(_by_dimension(sample.column("vector").chunk(0)), key=lambda x: len(x[0])) if sample.num_rows else []
    x = by_dim[-1][1] if by_dim else np.zeros((0, 0))
    centres = kmeans(x, clusters or max(1, min(1024, round(n**0.5)))) if x.size else np.zeros((0, 0))
    dim = x.shape[1] if x.size else -1
    known = rows.select("vector").mapInArrow(_measure(dim, centres), "cluster long, dist double, top double").groupBy("cluster").agg(F.count("*"), F.max("dist"), F.max("top")).collect()
    if any(top * top >= _EXACT for *_, top in known):
        raise OverflowError("inner products of these vectors can pass 2**52")
    counts, radii = np.zeros(len(centres) + _OTHERS, np.int64), np.zeros(len(centres) + _OTHERS)
    for cluster, count, dist, _ in known:
        counts[cluster], radii[cluster] = count, dist
    parts = np.maximum(1, -(-counts // group_rows))
    base, at, room = np.zeros_like(parts), -1, 0
    for c in range(len(parts)):  # small clusters share a group, large ones have several
        if parts[c] > 1 or counts[c] > room:
            base[c], room = at + 1, group_rows - counts[c] if parts[c] == 1 else 0
            at += parts[c]
        else:
            base[c] = at
            room -= counts[c]
    return _Index(dim, centres, radii, base, parts)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    clusters: int | None = None,
    sample_rows: int = 16_384,
    group_rows: int | None = None,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
) -> DataFrame:
    """Negatives near an anchor, but not as near as its positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products; higher ones come first, ties by smaller id. An anchor is a row for which the condition
    anchors holds. Its positives are its first other rows of the same label. For each of them, the first rows of another
    label are returned whose score lies between low_percent and high_percent of the positive's, both included.

    The index is k-means on at most 2 * sample_rows rows (about sqrt(rows) centres, 1024 at most, unless clusters is given), and
    every row is put in the list of its nearest centre, whose radius is stored, so the search is exact for any centres. Lists
    are dealt to groups of about group_rows rows (unless given, so many that every task has two, from 1,024 to 65,536); a list longer than that is split by id, so equal vectors do not gather in
    one task. An anchor first searches its own group, which gives a kth score; then it goes to the groups that have a
    cluster whose upper bound reaches that. Its positives' scores give the windows of the negatives, and it goes to the
    groups whose bounds meet one. In a group it visits clusters by upper bound, skips those outside its windows and stops when
    the bound falls strictly below the kth score. A task holds the lists of one group while anchors stream past it; vectors
    are shuffled three times whatever the number of anchors, and nothing but the sample and the radii reaches the driver.

    Rows with a null id, label or vector or a null component take no part. Repeated rows (equal id, label and vector) count
    once; a row never meets rows of its own id. Vectors of another dimension than the anchor's are no candidates; those of
    rarer dimensions than the sample's commonest lie in lists around the origin. Inner products that could pass 2**52 raise
    OverflowError. Fewer rows than asked give fewer results, an empty table none. Other columns are ignored.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<long>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists(F.coalesce("vector", F.array().cast("array<long>")), lambda x: x.isNull()))
    v = v.withColumn("row_key", F.xxhash64("label", "vector"))
    n = v.count()
    index = _index(v, n, clusters, sample_rows, group_rows or max(1024, min(65_536, n // (2 * shuffle_partitions(vectors.sparkSession)))))
    dealt = v.mapInArrow(_deal(index), "vec_id long, label string, vector array<long>, asks boolean, row_key long, cluster int, group long")
    lists = materialise(dealt.repartition("group").sortWithinPartitions("group", "cluster"), "negatives-lists")

    floors = lists.mapInArrow(_home(index, positives), "anchor_id long, anchor_key long, floor double").groupBy("anchor_id", "anchor_key").agg(F.max("floor").alias("floor"))
    asked = lists.where("asks").select("vec_id", "label", "vector", "row_key").dropDuplicates(["vec_id", "label", "vector"])
    on = [F.col("vec_id") == F.col("anchor_id"), F.col("row_key") == F.col("anchor_key")]
    infinite = F.lit(float("inf"))

    def search(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of each anchor and window."""
        out = asked.mapInArrow(_spread(index), "vec_id long, label string, vector array<long>, row_key long, windows array<struct<window: int, low: double, high: double>>, group long")
        rows = lists.select("group", F.lit(False).alias("asks"), "vec_id", "label", "vector", "cluster").unionByName(out.withColumn("asks", F.lit(True)), allowMissingColumns=True)
        rows = rows.repartition("group").sortWithinPartitions("group", "asks")
        found = rows.mapInArrow(_scan(index, same, k), "anchor_id long, anchor_key long, window long, vec_id long, score long")
        order = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    window = F.struct(F.lit(0).alias("window"), F.coalesce("floor", -infinite).alias("low"), infinite.alias("high"))
    first = asked.join(floors, on, "left").select(*asked.columns, F.array(window).alias("windows"))
    near = materialise(search(first, True, positives).select("anchor_id", "anchor_key", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    score = F.col("positive_score").cast("decimal(20,0)")
    ends = near.select(
        "anchor_id", "anchor_key", "window", F.ceil(score * low_percent / 100).cast("double").alias("low"), F.floor(score * high_percent / 100).cast("double").alias("high")
    ).where("low <= high")
    windows = ends.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))
    second = asked.join(windows, on).select(*asked.columns, "windows")
    hard = search(second, False, negatives)
    out = hard.join(near, ["anchor_id", "anchor_key", "window"])
    out = materialise(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(lists, near)
    return out
