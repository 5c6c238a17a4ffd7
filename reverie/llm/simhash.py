"""SimHash near-duplicates: exact Hamming-radius linking by a generalised pigeonhole over unequal bit partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, released
from .components import connected_components

BITS, BLOCK = 64, 16
_HASHES = 1 << 15
#: Relative cost of a probe row that is shuffled and of a candidate pair that is compared in memory.
_PROBE_COST, _PAIR_COST = 1.0, 0.004


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    n = max(1, len(words) - shingle_words + 1)
    stops = ends[min(shingle_words, len(words)) - 1 :] - 1

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, n, _HASHES):
            spans = zip(starts[at : min(n, at + _HASHES)].tolist(), stops[at : at + _HASHES].tolist())
            yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)

    return majority(hashes())


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of unsigned 64-bit numbers, which come in chunks; as a signed number."""
    total, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(released(run), "doc_id long, fp long")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        x = np.unpackbits(batch.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
        both += x.T @ x
        n += len(x)
    values = np.append(both.ravel(), n).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int64)), pa.array(values)], names=["cell", "n"])


def correlated_blocks(distinct: DataFrame) -> list[list[int]]:
    """Four blocks of 16 bits, the most correlated bits together; the counts of all fingerprints are summed to 64 x 64 numbers before they are read."""
    rows = distinct.select("fp").mapInArrow(_bit_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(BITS * BITS + 1)
    cells[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy()
    both, n = cells[:-1].reshape(BITS, BITS), max(cells[-1], 1)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, blocks = set(range(BITS)), []
    while free:
        block = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free -= {block[0]}
        while len(block) < BLOCK:
            best = max(free, key=lambda b: (corr[b, block].sum(), -b))
            block.append(best)
            free -= {best}
        blocks.append(sorted(block))
    return blocks


def _block_value(block: list[int]) -> str:
    return " | ".join(f"(shiftleft(shiftrightunsigned(fp, {b}) & 1L, {j}))" for j, b in enumerate(block))


def distance_distributions(distinct: DataFrame, blocks: list[list[int]]) -> tuple[int, list[np.ndarray]]:
    """The number of fingerprints, and for each block the share of ordered pairs at each distance within it.

    Exact, from the histogram of the block's 2**16 values over all fingerprints (so at most 4 x 65,536 counts are read)
    and its autocorrelation under exclusive or.
    """
    keyed = distinct.select(F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.expr(_block_value(b)).alias("value")) for i, b in enumerate(blocks)))).alias("x"))
    rows = keyed.groupBy("x.block", "x.value").agg(F.count("*").alias("n")).toPandas()
    n, out = int(rows["n"].sum()) // max(1, len(blocks)), []
    ones = np.bitwise_count(np.arange(1 << BLOCK, dtype=np.uint32))
    for i in range(len(blocks)):
        own = rows[rows["block"] == i]
        h = np.zeros(1 << BLOCK)
        h[own["value"].to_numpy(np.int64)] = own["n"].to_numpy(float) / max(n, 1)
        auto = _walsh(_walsh(h) ** 2) / (1 << BLOCK)
        out.append(np.maximum(np.bincount(ones, weights=auto, minlength=BLOCK + 1), 0))
    return n, out


def _walsh(x: np.ndarray) -> np.ndarray:
    for j in range(BLOCK):
        y = x.reshape(-1, 2, 1 << j)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], 1).ravel()
    return x


#: How the four blocks may form partitions.
_GROUPINGS = [[[0, 1], [2, 3]], [[0, 1], [2], [3]], [[0], [1], [2, 3]], [[0], [1], [2], [3]]]


def allocate(n: int, widths: list[int], shares: list[np.ndarray], radius: int) -> tuple[float, list[int]]:
    """Thresholds t with sum(t + 1) = radius + 1, each -1 (not probed) or more, at the least estimated cost.

    By the pigeonhole, fingerprints within radius are within t of each other in one of the partitions. A threshold costs its
    probes (a ball of radius t for each fingerprint) and its candidates (pairs within t there); the table runs over
    partitions and what is left of the sum.
    """

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        probes = n * sum(comb(widths[i], k) for k in range(t + 1))
        return probes * _PROBE_COST + n * n * float(shares[i][: t + 1].sum()) * _PAIR_COST

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(radius - used, widths[i]) + 1):
                at, total = used + t + 1, c + cost(i, t)
                if at <= radius + 1 and (at not in step or total < step[at][0]):
                    step[at] = (total, [*ts, t])
        best = step
    return best[radius + 1]


def choose_partitions(n: int, blocks: list[list[int]], shares: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """(bits as a mask, threshold) of each partition to probe."""
    plans = []
    for grouping in _GROUPINGS:
        dists = []
        for g in grouping:
            d = np.ones(1)
            for b in g:
                d = np.convolve(d, shares[b])
            dists.append(d)
        cost, ts = allocate(n, [BLOCK * len(g) for g in grouping], dists, radius)
        plans.append((cost, len(grouping), [(sum(1 << bit for b in g for bit in blocks[b]), t) for g, t in zip(grouping, ts) if t >= 0]))
    return min(plans)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probes(distinct: DataFrame, partitions: list[tuple[int, int]]) -> DataFrame:
    """(part, key, own, fp): own rows stand at their own key, the others at the keys within the threshold."""
    out = None
    for i, (mask, t) in enumerate(partitions):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]
        rows = distinct.select("fp", F.explode(F.array(*map(F.lit, flips)).cast("array<long>")).alias("flip")).select(
            F.lit(i).alias("part"), (F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("flip"))).alias("key"), (F.col("flip") == 0).alias("own"), "fp"
        )
        out = rows if out is None else out.union(rows)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it counts the bits of the absolute value


def _linker(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = col.offsets.to_numpy()
        return col.values.to_numpy(zero_copy_only=False).view(np.int64), offsets

    def forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Edges of a spanning forest of left against left and right."""
        nodes, n = np.concatenate([left, right]), len(left)
        free, edges = np.ones(len(nodes), bool), []
        for root in range(n):
            if not free[root]:
                continue
            free[root], queue = False, [root]
            while queue:
                at = queue.pop()
                pool = np.flatnonzero(free if at < n else free[:n])
                near = pool[_apart(nodes[pool], nodes[at]) <= radius]
                free[near] = False
                queue += near.tolist()
                edges += [(int(nodes[at]), int(x)) for x in nodes[near]]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lv, lo = lists(batch.column("own"))
            rv, ro = lists(batch.column("others"))
            nl, nr = np.diff(lo), np.diff(ro)
            nb = nl + nr
            small = nb <= 24
            a_out, b_out = [], []
            # few members: all pairs of the whole batch at once
            ids = np.flatnonzero(small & (nb > 1) & (nl > 0))
            if len(ids):
                base = np.cumsum(nb[ids]) - nb[ids]
                flat = np.empty(int(nb[ids].sum()), np.int64)
                for starts, counts, values, shift in ((lo, nl, lv, np.zeros_like(nl)), (ro, nr, rv, nl)):
                    c = counts[ids]
                    within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    flat[np.repeat(base + shift[ids], c) + within] = values[np.repeat(starts[:-1][ids], c) + within]
                pairs = nl[ids] * nb[ids]
                k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                width, first = np.repeat(nb[ids], pairs), np.repeat(base, pairs)
                x, y = flat[first + k // width], flat[first + k % width]
                hit = (_apart(x, y) <= radius) & (x != y)
                a_out.append(x[hit])
                b_out.append(y[hit])
            for i in np.flatnonzero(~small & (nl > 0)):
                if edges := forest(lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]):
                    e = np.array(edges, np.int64)
                    a_out.append(e[:, 0])
                    b_out.append(e[:, 1])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                e = e[e[:, 0] != e[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return run


def hamming_links(distinct: DataFrame, partitions: list[tuple[int, int]], radius: int, chunk: int = 1024, hot_rows: int = 200_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within radius: for every linked pair, a path of edges.

    Fingerprints meet at the keys of the partitions. A key with more than chunk rows is dealt by hash into k pieces and
    each pair of pieces is compared on its own, so no list grows with the key. A list gives a spanning forest, not pairs.
    """
    rows = _probes(distinct, partitions)
    hot = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("part", "key", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    hot = materialise(hot, "simhash-hot")
    # few keys are that large; should they be many after all, the join is an ordinary one
    hot = F.broadcast(hot) if hot.count() <= hot_rows else hot
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    left = F.transform(every, lambda x: F.struct(F.col("c").alias("i"), x.alias("j"), F.lit(True).alias("own")))
    right = F.transform(every, lambda x: F.struct(x.alias("i"), F.col("c").alias("j"), F.lit(False).alias("own")))
    spread = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("own").alias("own")))).otherwise(
        F.when(F.col("own"), F.concat(left, F.filter(right, lambda u: u["i"] != u["j"]))).otherwise(right)
    )
    units = rows.join(hot, ["part", "key"], "left").withColumn("c", mine).select("part", "key", "fp", F.explode(spread).alias("u"))
    lists = units.groupBy("part", "key", "u.i", "u.j").agg(
        F.collect_list(F.when(F.col("u.own"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("u.own"), F.col("fp"))).alias("others")
    )
    lists = lists.where((F.size("own") > 0) & (F.size("own") + F.size("others") > 1)).select("own", "others")
    return lists.mapInArrow(_linker(radius), "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the fingerprints fp of a materialised table of distinct ones, within radius and leaving no linked pair without a path."""
    blocks = correlated_blocks(distinct)
    n, shares = distance_distributions(distinct, blocks)
    return hamming_links(distinct, choose_partitions(n, blocks, shares, radius), radius)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most radius bits, directly or through others.

    Equal fingerprints are one class from the start, so copies never form pairs. Bits are grouped into partitions by their
    correlation, thresholds are allocated to partitions by dynamic programming on estimated candidate counts (both from
    all fingerprints), and the distinct fingerprints are probed, verified and contracted to components.

    ASCII letters are folded to lower case and words are split at ASCII white space. Null and empty texts, and texts of
    white space, have fingerprint zero and are linked like any others; fewer words than a shingle make one shingle. Repeated
    rows share a component; rows with a null doc_id are kept, and a component with no other id has a null component_id. Very
    long texts are hashed whole. An empty table gives an empty result. Other columns are ignored.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id (the least doc_id of the component).
    """
    fps = materialise(fingerprints(docs, shingle_words, id_col, text_col), "simhash-fps")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, radius)).withColumnRenamed("node", "fp")
    linked = materialise(distinct.join(roots, "fp"), "simhash-linked")
    lows = materialise(linked.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lows")
    owned = lookup(linked, lows, "root").select("fp", "component_id")
    classes = materialise(distinct.join(owned, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "simhash-classes")
    return lookup(fps, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
