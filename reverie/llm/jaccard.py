"""Near-duplicates by SimHash and an exact set-similarity join: every pair of texts whose word shingles have a Jaccard similarity of at least a threshold."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, lookup, materialise, released
from .components import connected_components
from .simhash import fingerprint_links, majority

#: Texts whose shingles are counted for the order, and shingles that the order puts last.
_SAMPLE, _COMMON = 5_000, 200_000
#: Rows of an output batch, buckets of a sketch at least, and set ids that are broadcast (24 bytes each); more are joined by shuffle.
_ROWS, _BUCKETS, _BROADCAST = 256, 1024, 1_000_000
#: 64-bit numbers of a folded sketch.
_FOLDS = 8
#: Rounds of drawn centres.
_DRAWS = 2


def shingle_set(text: str | None, shingle_words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 values of the word shingles in ascending order, as signed numbers; words as in simhash.fingerprint."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle_words + 1)]
    stops = ends[min(shingle_words, len(words)) - 1 :]
    spans = zip(starts.tolist(), stops.tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(starts)).view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """Of n shingles in a common order, so many of the first must hold one of any set that is similar enough: it shares at least ceil(similarity * n)."""
    return n - ceil(similarity * n - 1e-9) + 1


def buckets(n: int) -> int:
    """Buckets of the sketch of a set of size n: a power of two, twice the size at least, so that sets that differ in more than a similarity allows do not fill it."""
    return max(_BUCKETS, 1 << (2 * n - 1).bit_length())


def _lists(rows: list[np.ndarray], dtype: type) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([np.empty(0, dtype), *rows])))


class _Prefix:
    """The first shingles of a set in the order: by hash, and after all others the common ones, the most common last."""

    def __init__(self, common: np.ndarray, similarity: float):
        self.common, self.similarity = common, similarity
        self.by_hash = np.argsort(common)
        self.known = common[self.by_hash]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        p = prefix_length(len(h), self.similarity)
        if not len(self.known):
            return h[:p]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        held = self.known[at] == h
        rare = h[~held]
        return rare[:p] if len(rare) >= p else np.append(rare, self.common[np.sort(self.by_hash[at[held]])[: p - len(rare)]])


def shingle_sets(texts: DataFrame, common: np.ndarray, similarity: float, shingle_words: int) -> DataFrame:
    """doc_id, text_hash, set_id (equal for equal sets), n (its size), fp (SimHash of the set), sketch, prefix.

    sketch: whether each of buckets(n) buckets holds an odd number of the set's hashes, as bits. prefix: the first
    prefix_length shingles in the common order, once for equal sets of a task and empty where repeated.
    """
    columns = ("doc_id", "text_hash", "set_id", "n", "fp", "sketch", "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        first, seen, none = _Prefix(common, similarity), set(), np.empty(0, np.int64)

        def fresh(i: int, s: np.ndarray) -> np.ndarray:
            if not len(s) or i in seen:
                return none
            seen.add(i)
            return first(s)

        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                sets = [shingle_set(t.as_py(), shingle_words) for t in batch.column("text")]
                ids = np.fromiter((xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                sizes = np.fromiter(map(len, sets), np.int32, len(sets))
                prints = np.fromiter((majority([s.view(np.uint64)]) for s in sets), np.int64, len(sets))
                odd = [np.packbits(np.bincount(s & (m - 1), minlength=m) & 1).view(np.int64) for s, m in zip(sets, map(buckets, map(len, sets)))]
                prefixes = [fresh(i, s) for i, s in zip(ids.tolist(), sets)]
                cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(ids), pa.array(sizes), pa.array(prints), _lists(odd, np.int64), _lists(prefixes, np.int64)]
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return texts.mapInArrow(released(run), "doc_id long, text_hash long, set_id long, n int, fp long, sketch array<long>, prefix array<long>")


def common_shingles(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """Shingles that occur in more than one text of a sample, at most _COMMON of them, the most common last. They only order the prefixes: any list gives the same links."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle_words))], names=["hash"])

    sample = texts.where(F.pmod("text_hash", F.lit(max(1, n // _SAMPLE))) == 0).select("text", "text_hash").dropDuplicates(["text_hash"]).select("text")
    often = sample.mapInArrow(run, "hash long").groupBy("hash").count().where("count > 1").orderBy(F.desc("count"), "hash").limit(_COMMON)
    return often.toPandas()["hash"].to_numpy(np.int64)[::-1].copy()


_SHARED = ("hash", "set_id", "n", "pos", "centre", "centre_n", "centre_pos")
_SHARED_TYPES = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of (hash, set_id), those whose hash has another set_id, with the first of their hash as its centre; repeated rows once."""
    last, joined = [np.empty(0, t) for t in _SHARED_TYPES], False  # a row held back, and whether the one before it has its hash
    for batch in batches:
        h, s, n, p = (np.append(x, batch.column(c).to_numpy()) for x, c in zip(last, _SHARED[:4]))
        if not len(h):
            continue
        fresh = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        h, s, n, p = h[fresh], s[fresh], n[fresh], p[fresh]
        first = np.append(True, h[1:] != h[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        c, cn, cp = s[start], n[start], p[start]
        if len(last[0]):  # the group that goes on has its centre from before
            own = start == 0
            c[own], cn[own], cp[own] = last[4][0], last[5][0], last[6][0]
        same = np.append(joined, ~first[1:])
        keep, columns = same[:-1] | same[1:], (h, s, n, p, c, cn, cp)
        last, joined = [x[-1:] for x in columns], bool(same[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in columns], names=_SHARED)
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=_SHARED)


def _held_sets(texts: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """set_id and the sorted upper halves of its shingles' hashes, of the wanted (doc_id, text_hash, set_id), from the texts again."""
    keys = wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "set_id")
    keys = F.broadcast(keys) if wanted.count() <= _BROADCAST else keys
    rows = texts.join(keys, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a task stand once
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = batch.column("set_id").to_pylist()
                fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
                halves = [np.unique(shingle_set(batch.column("text")[i].as_py(), shingle_words) >> 32).astype(np.int32) for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in fresh], pa.int64()), _lists(halves, np.int32)], names=["set_id", "halves"])

    return rows.mapInArrow(released(run), "set_id long, halves array<int>")


def overlap(na: str, nb: str, similarity: float) -> Column:
    """How many shingles sets of these sizes share at least."""
    return F.ceil((F.col(na) + F.col(nb)) * (similarity / (1 + similarity)) - 1e-9)


def allowed(similarity: float) -> Column:
    """In how many shingles sets of sizes n_a and n_b may differ, and so in how many odd buckets at most."""
    return (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def folded(k: int) -> Column:
    """Number k of the sketch folded to _FOLDS numbers: parities of buckets that lie 64 * _FOLDS apart add up, so it is a sketch of as many buckets."""
    return F.aggregate(F.filter("sketch", lambda _, i: i % _FOLDS == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def apart() -> Column:
    """In how many buckets the sketches of sets a and b differ. Sizes of similar sets are so near that the one sketch is at most twice as long; its halves add up to the other's length."""

    def even(own: str, other: str) -> Column:
        half = F.size(own) - F.size(other)
        twice = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(half > 0, twice).otherwise(F.col(own))

    bits = F.zip_with(even("sketch_a", "sketch_b"), even("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda n, x: n + x)


def _similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """Of distinct pairs (a, b) of set ids, those of similarity or more by their whole sets.

    Sketches differ in at most as many bits as the sets have shingles that are not common, so pairs whose sketches differ in
    more than the similarity allows are out before any text is read again.
    """

    def sides(of: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        a, b = (table.select(F.col("set_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
        return of.join(a, "a").join(b, "b")

    pairs = materialise(pairs, "copies-pairs")
    sized = F.least("n_a", "n_b") >= overlap("n_a", "n_b", similarity)
    near = materialise(sides(pairs, classes, ["n", "sketch"]).where(sized & (apart() <= allowed(similarity))).select("a", "b"), "copies-near")
    ids = near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = materialise(classes.join(ids, "set_id", "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "set_id"), "copies-wanted")
    held = materialise(_held_sets(texts, wanted, shingle_words), "copies-held")
    both = sides(near, held, ["halves"]).withColumn("common", F.size(F.array_intersect("halves_a", "halves_b")))
    found = materialise(both.where(F.col("common") / (F.size("halves_a") + F.size("halves_b") - F.col("common")) >= similarity).select("a", "b"), "copies-links")
    discard(pairs, near, wanted, held)
    return found


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(sets: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, shingle_words: int, radius: int) -> DataFrame:
    """Edges (a, b) between set ids: all of similarity or more, directly or through a path of other such edges.

    1. SimHash: sets of one fingerprint are compared with one of them, and fingerprints within radius, found by the
       generalised pigeonhole, by one set of each. That joins most copies at little cost. It misses pairs whose
       fingerprints lie farther apart, as about half of those at 0.8 do.
    2. Prefix filter, which leaves none out. In any order of all shingles, two sets of sizes m and n of that similarity have
       at least k = ceil(similarity / (1 + similarity) * (m + n)) in common, so one of the first m - k + 1 of the one is among
       the first n - k + 1 of the other. Shingles that are common in a sample go last, so boilerplate makes no candidates unless
       a text is little else; the order changes the cost and never the result. Sets meet by the shingles they share
       there: first each with one set of the shingle, the same for many shingles, then in two rounds with one drawn for every
       shingle from its largest component, which joins large groups of copies by a number of pairs in proportion to their rows, then all pairs that are
       still in different components.
    3. In that last step, prefixes hold more than one shingle of a similar set: sets share k shingles, and after the end of the
       prefix that ends first its set, of size n, has ceil(similarity * n) - 1 left, so prefixes share what remains of k at least. Shingles that
       the same sets have are one, with their number as weight. Each set's are put in the order of how many sets have them,
       and the first that two sets share is followed by that weight in both, so they meet only at shingles where it is.
    """
    prints = materialise(classes.where("n > 0").groupBy("fp").agg(F.min("set_id").alias("set_id")), "copies-prints")
    of = lookup(classes.where("n > 0").select("fp", F.col("set_id").alias("a")), prints.withColumnRenamed("set_id", "b"), "fp").select("a", "b")
    near = fingerprint_links(prints, radius)
    x, y = prints.select(F.col("fp").alias("a"), F.col("set_id").alias("ra")), prints.select(F.col("fp").alias("b"), F.col("set_id").alias("rb"))
    across = near.join(x, "a").join(y, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    links = _similar(_ordered(of.union(across)), classes, texts, similarity, shingle_words)
    discard(prints)

    rows = sets.select(F.posexplode("prefix").alias("pos", "hash"), "set_id", "n")
    schema = "hash long, set_id long, n int, pos int, centre long, centre_n int, centre_pos int"
    rows = materialise(rows.repartition("hash").sortWithinPartitions("hash", "set_id").mapInArrow(_shared, schema), "copies-shared")

    def reach(na: str, pa_: str, nb: str, pb: str) -> Column:
        least = overlap(na, nb, similarity)
        return (F.col(pa_) <= F.col(na) - least) & (F.col(pb) <= F.col(nb) - least)

    stars = rows.where((F.col("set_id") != F.col("centre")) & reach("n", "pos", "centre_n", "centre_pos")).select(F.col("set_id").alias("a"), F.col("centre").alias("b"))
    links = links.union(_similar(_ordered(stars), classes, texts, similarity, shingle_words))

    def mixed_groups(of: DataFrame, name: str, last: bool = False) -> DataFrame:
        """The rows of the hashes whose sets are in more than one component, with the component as root; at last one hash of those with the same sets, with held (its sets) and weight (such hashes)."""
        roots = connected_components(links).withColumnRenamed("node", "set_id")
        rooted = lookup(of.select("hash", "set_id", "n", "pos"), roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        now = materialise(rooted, "copies-rooted")
        sets_of = [F.count("*").alias("held"), *(F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"sets{i}") for i in range(2))] if last else []
        mixed = now.groupBy("hash").agg(F.min("root").alias("x"), F.max("root").alias("y"), *sets_of).where("x <> y").drop("x", "y")
        if last:
            mixed = mixed.groupBy("held", "sets0", "sets1").agg(F.min("hash").alias("hash"), F.count("*").alias("weight")).select("hash", "held", "weight")
        mixed = materialise(mixed, "copies-mixed-hashes")
        out = materialise(now.join(F.broadcast(mixed) if mixed.count() <= _BROADCAST else mixed, "hash"), name)
        discard(now, roots, mixed)
        return out

    left = mixed_groups(rows, "copies-mixed")
    for draw in range(_DRAWS):
        # a centre for every hash, drawn from the component that most of its sets are in: what belongs there finds it in a few draws
        drawn = F.min_by(F.struct("set_id", "n", "pos", "root"), F.xxhash64("set_id", "hash", F.lit(draw)))
        per = left.groupBy("hash", "root").agg(F.count("*").alias("m"), drawn.alias("c"))
        centres = materialise(per.groupBy("hash").agg(F.max_by("c", F.struct("m", "root")).alias("c")), "copies-centres")
        stars = lookup(left, centres, "hash").where(F.col("root") != F.col("c.root")).select("set_id", "n", "pos", *(F.col(f"c.{c}").alias(f"centre_{c}") for c in ("set_id", "n", "pos")))
        stars = stars.where(reach("n", "pos", "centre_n", "centre_pos")).select(F.col("set_id").alias("a"), F.col("centre_set_id").alias("b"))
        links = links.union(_similar(_ordered(stars), classes, texts, similarity, shingle_words))
        now = mixed_groups(left, "copies-left", draw == _DRAWS - 1)
        discard(left, centres)
        left = now

    # folded sketches tell most pairs apart where they meet, unless texts are long
    own = Window.partitionBy("set_id")
    before = F.coalesce(F.sum("weight").over(own.orderBy("held", "hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = left.select("hash", "set_id", "n", "root", (F.sum("weight").over(own) - before).cast("int").alias("ahead"))
    marked = ahead.join(classes.select("set_id", *(folded(k).alias(f"mark{k}") for k in range(_FOLDS))), "set_id")
    a, b = (marked.select("hash", *(F.col(c).alias(f"{c}_{x}") for c in ("set_id", "n", "root", "ahead", *(f"mark{k}" for k in range(_FOLDS))))) for x in "ab")
    differ = sum((F.bit_count(F.col(f"mark{k}_a").bitwiseXOR(F.col(f"mark{k}_b"))) for k in range(_FOLDS)), F.lit(0))
    shared = overlap("n_a", "n_b", similarity)
    within = shared - F.greatest(*(F.ceil(F.col(n) * similarity - 1e-9) - 1 for n in ("n_a", "n_b")))
    new = (F.col("set_id_a") < F.col("set_id_b")) & (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") >= shared)
    met = a.join(b, "hash").where(new & (F.least("ahead_a", "ahead_b") >= within) & (differ <= allowed(similarity)))
    links = links.union(_similar(_ordered(met.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))), classes, texts, similarity, shingle_words))
    discard(rows, left)
    return links


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of at least similarity, directly or through others.

    SimHash fingerprints find most of them, a prefix-filter join the rest (see similar_links), and whole sets decide. No
    similar pair is left out, and none below the threshold is linked, but for collisions of hashes: candidates meet by 64
    bits of a shingle's hash and are compared by 32 of them. ASCII letters are folded to lower case and words are split at
    ASCII white space; fewer words than a shingle make one shingle. Null, empty and blank texts are copies of each other.
    Equal sets are one class from the start. Rows with a null doc_id are kept, and a component with no other id has a null
    component_id; rows that share an id are compared by their own texts. An empty table gives an empty result. Other columns
    are ignored. Texts are read three times and more, so docs should be a table.

    Returns a row for each of docs: doc_id, text_hash (XXH64 of the text, as Spark's xxhash64), set_id, component_id (the
    least doc_id of the component), kept (doc_id and text_hash of the one row of the component to keep: the least doc_id,
    null ids last, then the least text_hash).
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = materialise(shingle_sets(texts, common_shingles(texts, shingle_words), similarity, shingle_words), "copies-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = materialise(sets.groupBy("set_id").agg(first.alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("sketch").alias("sketch")), "copies-classes")
    roots = connected_components(similar_links(sets, classes, texts, similarity, shingle_words, radius)).withColumnRenamed("node", "set_id")
    rooted = materialise(classes.select("set_id", "first").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "copies-roots")
    best = materialise(rooted.groupBy("root").agg(F.min("first").alias("kept")), "copies-best")
    owners = materialise(lookup(rooted.select("set_id", "root"), best, "root").select("set_id", "kept"), "copies-owners")
    out = lookup(sets.select("doc_id", "text_hash", "set_id"), owners, "set_id")
    discard(classes, roots, rooted, best)
    return out.select("doc_id", "text_hash", "set_id", F.col("kept.doc_id").alias("component_id"), F.struct("kept.doc_id", "kept.text_hash").alias("kept"))
