"""Exact top-k inner-product search with KD-trees per shard."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete, discard, materialise, new_path, released

#: Inner products below these are exact in doubles and in 64-bit integers; larger ones take Python's integers.
_DOUBLE, _LONG = 1 << 52, 1 << 62


class KDTree:
    """Median splits of integer vectors, with the tight bounding box of every node.

    A node is a range of the reordered rows. It is split at the median of its widest dimension until it has leaf_size rows
    or its box is a point, so any number of equal vectors is one leaf.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_size: int = 128):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, ...]] = []  # first row, end row, and the children of an inner node
        lows, highs = [], []
        todo = [(0, len(ids), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            rows = vectors[order[lo:hi]]
            low, high = rows.min(0), rows.max(0)
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent] += (at,)
            self.nodes.append((lo, hi))
            lows.append(low)
            highs.append(high)
            dim = int(np.argmax(high - low)) if len(high) else 0
            if hi - lo > leaf_size and len(high) and high[dim] > low[dim]:
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows[:, dim], mid)]
                todo += [(lo + mid, hi, at), (lo, lo + mid, at)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.leaves, self.read = sum(len(n) == 2 for n in self.nodes), 0

    def search(self, query: np.ndarray, own_id: int, k: int, floor: int | None = None, best: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """Adds to best, a heap of at most k (score, -id), the rows but own_id's that belong to the k best so far and score at least floor.

        Nodes are visited in the order of their bounds until none can hold a better row; read counts the leaves that were.
        """
        best = [] if best is None else best
        bounds = np.where(query >= 0, self.highs, self.lows) @ query  # no vector in a box scores more
        least = best[0][0] if len(best) == k else floor
        front = [(-bounds[0], 0)] if len(self.nodes) else []
        while front:
            bound, at = heapq.heappop(front)
            if least is not None and -bound < least:
                break
            lo, hi, *children = self.nodes[at]
            for child in children:
                heapq.heappush(front, (-bounds[child], child))
            if children:
                continue
            self.read += 1
            scores = self.vectors[lo:hi] @ query
            for j in range(hi - lo) if least is None else np.flatnonzero(scores >= least):
                if (vec_id := int(self.ids[lo + j])) != own_id:
                    item = (int(scores[j]), -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            least = best[0][0] if len(best) == k else floor
        return best


def _top(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))


def _by_dimension(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) of each dimension; vectors of different dimensions never meet."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def _kind(most: int) -> type:
    """Numbers that hold inner products of this size exactly."""
    return np.float64 if most < _DOUBLE else np.int64 if most < _LONG else object


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after another; rows arrive in the order of shards."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and hi > lo and held[0].column("shard")[0].as_py() != shards[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _vectors_of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each dimension, repeated rows once."""
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy()
    for own, matrix in _by_dimension(table.column("vector").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))):
        if len(np.unique(ids[own])) < len(own):
            once = np.unique(np.column_stack([ids[own], matrix]), axis=0)
            yield once[:, 0], once[:, 1:]
        else:
            yield ids[own], matrix


def _home(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id and the kth score in the query's own shard, null where that holds fewer rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _shards(batches):
            asks = table.column("asks").to_numpy()
            if not asks.any():
                continue
            held = {x.shape[1]: (ids, x) for ids, x in _vectors_of(table.filter(pa.array(~asks)))}
            for query_ids, queries in _vectors_of(table.filter(pa.array(asks))):
                floors: list[int | None] = [None] * len(query_ids)
                if (dim := queries.shape[1]) in held:
                    ids, x = held[dim]
                    kind = _kind(_top(x) * _top(queries) * max(1, dim))
                    tree = KDTree(ids, x.astype(kind))
                    for i, (own, q) in enumerate(zip(query_ids.tolist(), queries.astype(kind))):
                        best = tree.search(q, own, k)
                        floors[i] = best[0][0] if len(best) == k and -_LONG < best[0][0] < _LONG else None
                yield pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(floors, pa.int64())], names=["query_id", "floor"])

    return released(run)


def _blocks(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The queries that lie in a folder of the shared store, so many at a time."""
    fs, inside = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    for info in sorted(fs.get_file_info(pafs.FileSelector(inside)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows, columns=["vec_id", "vector", "floor"])


def _search(k: int, uri: str, most: int, block_rows: int, held_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task builds the trees of its shards, up to held_rows vectors at once, and passes all queries by them; most is the largest component of a query."""

    def answers(trees: dict[int, list[KDTree]]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(uri, block_rows):
            ids, floors = block.column("vec_id").to_pylist(), block.column("floor").to_pylist()
            found = []
            for own, queries in _by_dimension(block.column("vector")):
                near = trees.get(queries.shape[1], [])
                cast = {kind: queries.astype(kind) for kind in {t.vectors.dtype for t in near}}
                for at, i in enumerate(own.tolist()):
                    best: list[tuple[int, int]] = []
                    for tree in near:
                        tree.search(cast[tree.vectors.dtype][at], ids[i], k, floors[i], best)
                    found += [(ids[i], -n, max(-(1 << 63), min((1 << 63) - 1, score))) for score, n in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held = {}, 0
        for table in _shards(batches):
            for ids, x in _vectors_of(table):
                trees.setdefault(x.shape[1], []).append(KDTree(ids, x.astype(_kind(_top(x) * most * max(1, x.shape[1])))))
                held += len(ids)
            if held >= held_rows:
                yield from answers(trees)
                trees, held = {}, 0
        if trees:
            yield from answers(trees)

    return released(run)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 8192, held_rows: int = 1 << 18, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """The k vectors of largest integer inner product for every query but itself: query_id, rank, vec_id, score.

    Vectors are dealt by hash to shards of about shard_rows and lie in their order, so one shuffle moves each vector once. Round
    one asks each query in its own shard alone and so learns a kth score. The queries with those scores are written to the shared
    folder once. In round two a task builds the trees of its shards, up to held_rows vectors at once, each tree once, and
    reads the queries past them, block_rows at a time; the best of a query so far, at least its score of round one, is the bound
    below which subtrees and rows are passed over, from tree to tree. Only a task's k best rows for a query leave it. So the
    plan is the same for any number of queries, and none of them passes through the driver. In many dimensions boxes bound
    poorly and most leaves are read, as in any exact search.

    Ties go to the smaller id. Null vectors and vectors with null components take no part. Repeated rows of one id and
    vector count once. Fewer than k candidates give fewer rows; empty tables give an empty result. Queries with a null
    id are left out, as are candidates. Vectors of another dimension than the query's are no candidates. Scores are compared
    exactly at any size and held at the ends of 64 bits when they are returned.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<long>").alias("vector"))
        return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists(F.coalesce("vector", F.array().cast("array<long>")), lambda x: x.isNull()))

    rows = clean(vectors)
    n_shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_shards)).cast("int")
    every = rows.withColumn("asks", F.lit(False)).union(clean(queries).distinct().withColumn("asks", F.lit(True))).withColumn("shard", shard)
    every = materialise(every.repartition("shard").sortWithinPartitions("shard"), "topk-shards")
    asked = every.where("asks").select("vec_id", "vector")
    floors = every.mapInArrow(_home(k), "query_id long, floor long").groupBy("query_id").agg(F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("floor"))
    asked = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "vector", "floor")
    uri = new_path(every.sparkSession, "topk-queries")
    asked.write.parquet(uri)
    most = every.where("asks").agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()[0]
    held = every.where("not asks").select("vec_id", "vector", "shard")
    found = held.mapInArrow(_search(k, uri, int(most or 0) + 1, block_rows, held_rows), "query_id long, vec_id long, score long")
    found = materialise(found, "topk-found")
    delete(every.sparkSession, uri)
    discard(every)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
