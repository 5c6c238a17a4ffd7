"""Benchmark decontamination with built-in functions: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise

BITS = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """XXH64 of every k words in a row; fewer words give none."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def all_of(h: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(F.size(h) >= k, rows).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, all_of)


def simhash(hashes: Column) -> Column:
    """A bit is set if it is set in over half of the hashes."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int")),
    )
    n = F.size(hashes)
    return F.aggregate(
        F.zip_with(bits, F.sequence(F.lit(0), F.lit(BITS - 1)), lambda c, b: F.when(c * 2 > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda x, y: x.bitwiseOR(y),
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming_blocks(radius: int, within: int) -> list[int]:
    """Masks of the fewest blocks of bits such that fingerprints within radius differ in at most within bits of some block."""
    n = radius // (within + 1) + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]


def _block_keys(fp: Column, masks: list[int], within: int) -> Column:
    """array<struct<block, value>>: for every block, the values within that many bits of the fingerprint's own."""
    keys = []
    for i, mask in enumerate(masks):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [_signed(sum(1 << b for b in c)) for t in range(within + 1) for c in combinations(bits, t)]
        own = fp.bitwiseAND(F.lit(_signed(mask)))
        keys += [F.struct(F.lit(i).alias("block"), (own.bitwiseXOR(F.lit(f)) if f else own).alias("value")) for f in flips]
    return F.array(*keys)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weight of every shingle, its weight in a list being how often it occurs there."""
    common = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
    )
    return common / (F.size(a) + F.size(b) - common)


def _shingle_strings(words: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def benchmark_items(benchmark: DataFrame, shingle_words: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words, n_words, k (words of its shingles), n_shingles, hashes; items without a word are left out."""
    items = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), words_of(benchmark[text_col]).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n_words", F.size("words")).withColumn("k", F.least(F.col("n_words"), F.lit(shingle_words)))
    hashes = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("words"), k)) for k in range(1, shingle_words + 1)))
    return items.withColumn("hashes", hashes).withColumn("n_shingles", F.size("hashes"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
    within: int = 2,
    broadcast_rows: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, start_word, n_words, hamming, similarity of the best window.

    1. Windows. A window can only be similar to an item if it shares at least similarity times the item's shingles with it,
       also where the end of the text makes it shorter than the item. So it shares one of the item's rarest shingles, of as
       many as leave out fewer than that; those alone make pairs of a row and an item, and a shingle that many items hold
       makes none unless an item has no rarer ones. Pairs with enough common shingles give windows of the item's length,
       one for each alignment of a common shingle. This leaves out no similar window at such an alignment.
    2. Candidates. A window meets every item of its length by their SimHash fingerprints, whichever item gave the window: bits
       are split into blocks so that fingerprints within radius differ in at most `within` bits of one block; items stand at
       all such values, windows at their own.
    3. Verification. Candidates within radius are kept if their exact weighted-shingle similarity reaches similarity. At
       0.8, fingerprints differ in 10 bits on average and in over 20 for about one pair in 10,000, which are lost.

    Words are lower-cased runs of letters and digits, so case, punctuation and layout do not hide a passage. Items with fewer
    words than a shingle are one shingle of all their words. Null and empty texts hold nothing; items without a word match
    nothing. Rows are searched one by one; those that share a doc_id (or have none) count as one document: it holds an item if
    one of its rows does. Equal windows tie to the smallest start. Very long texts are searched whole; a task holds the hashes of one.
    Empty tables give an empty result. Other columns are ignored.

    Of the document table only shingle hashes that occur in the benchmark leave the scan; texts are read again for rows
    with windows. The item tables are broadcast up to broadcast_rows rows and joined by shuffle beyond.
    """
    items = materialise(benchmark_items(benchmark, shingle_words), "decontam-items")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))  # tells rows apart; equal rows are one
    placed = materialise(items.select("item_id", "n_words", "n_shingles", "k", F.posexplode("hashes").alias("item_at", "hash")), "decontam-placed")
    n_placed, sizes = placed.count(), [r["k"] for r in items.select("k").distinct().collect()]  # sizes: at most shingle_words numbers

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_placed <= broadcast_rows else df

    least = F.ceil(F.col("n_shingles") * similarity - 1e-9)  # common shingles of an item and a window of any length
    often = placed.groupBy("hash", "k").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("often", "hash", "item_at"))
    rare = placed.join(often, ["hash", "k"]).withColumn("place", place).where(F.col("place") <= F.col("n_shingles") - least + 1).select("hash", "k", "item_id").distinct()

    hashed = let(words_of(F.col("text")), lambda w: F.array(*(F.struct(F.lit(k).alias("k"), shingle_hashes(w, k).alias("hashes")) for k in sizes or [shingle_words])))
    rows = texts.select("doc_id", "row", F.explode(hashed).alias("s")).select("doc_id", "row", F.col("s.k").alias("k"), F.posexplode("s.hashes").alias("at", "hash"))
    hits = rows.join(small(placed.select("hash", "k").distinct()), ["hash", "k"], "left_semi")
    hits = materialise(hits, "decontam-hits")

    met = materialise(hits.join(small(rare), ["hash", "k"]).select("row", "item_id").distinct(), "decontam-met")
    met = F.broadcast(met) if met.count() <= broadcast_rows // 4 else met
    aligned = hits.join(met, "row").join(small(placed), ["item_id", "hash", "k"])
    pairs = aligned.groupBy("row", "item_id", "n_shingles").agg(F.countDistinct("at").alias("n")).where(F.col("n") >= least).select("row", "item_id")
    pairs = materialise(pairs, "decontam-pairs")
    windows = (
        aligned.join(F.broadcast(pairs) if pairs.count() <= broadcast_rows // 4 else pairs, ["row", "item_id"])
        .select("row", F.greatest(F.col("at") - F.col("item_at"), F.lit(0)).alias("start"), "n_words", "k")
        .distinct()
    )
    per_row = materialise(windows.groupBy(F.col("row").alias("own")).agg(F.collect_list(F.struct("start", "n_words", "k")).alias("windows")), "decontam-windows")
    held = F.broadcast(per_row) if per_row.select(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0] <= broadcast_rows // 20 else per_row
    cut = texts.join(held, texts["row"] == per_row["own"]).select(
        "doc_id",
        F.explode(
            let(
                words_of(F.col("text")),
                lambda w: F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n_words"].alias("n_words"), x["k"].alias("k"), F.slice(w, x["start"] + 1, x["n_words"]).alias("words"))),
            )
        ).alias("w"),
    )
    cut = cut.select("doc_id", "w.*").where(F.size("words") >= F.col("k"))
    prints = F.coalesce(*(F.when(F.col("k") == k, simhash(shingle_hashes(F.col("words"), k))) for k in sizes or [shingle_words]))
    windows = materialise(cut.withColumn("fp", prints), "decontam-prints")

    near = candidates(windows, items, radius, within)
    exact = let(_shingle_strings(F.col("words"), F.col("k")), lambda a: let(_shingle_strings(F.col("item_words"), F.col("k")), lambda b: weighted_similarity(a, b)))
    kept = near.withColumn("similarity", exact).where(F.col("similarity") >= similarity)
    best = F.min_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct(-F.col("similarity"), "start"))
    found = materialise(kept.groupBy("doc_id", "item_id").agg(best.alias("b")), "decontam-found")
    discard(items, placed, hits, pairs, per_row, windows)
    return found.select("doc_id", "item_id", F.col("b.start").alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"))


def candidates(windows: DataFrame, items: DataFrame, radius: int, within: int) -> DataFrame:
    """windows (doc_id, start, n_words, k, words, fp) with every item of their length whose fingerprint lies within radius: item_id, item_words, hamming; each pair once. Windows with an item_id meet that item alone.

    They meet at the values of multi-index blocks, so a window is compared with no item that it agrees with in no block.
    """
    return met_in_blocks(windows, items, radius, within).where(F.col("hamming") <= radius).select("doc_id", "start", "n_words", "k", "words", "item_id", "item_words", "hamming").distinct()


def met_in_blocks(windows: DataFrame, items: DataFrame, radius: int, within: int) -> DataFrame:
    """The pairs that the index compares, once for every block that they meet in."""
    masks = hamming_blocks(radius, within)
    prints = materialise(items.select("item_id", "n_words", "k", F.col("words").alias("item_words"), let(F.col("hashes"), simhash).alias("item_fp")), "decontam-item-prints")
    at_items = prints.withColumn("at", F.explode(_block_keys(F.col("item_fp"), masks, within)))
    at_windows = windows.withColumn("at", F.explode(_block_keys(F.col("fp"), masks, 0)))
    own = [c for c in ("item_id",) if c in windows.columns]
    return at_windows.join(at_items, ["n_words", "k", "at", *own]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
