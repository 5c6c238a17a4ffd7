"""Spelling variants: words one letter apart, found through groups of keys and never as pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, discard, lookup, materialise, placed, released

#: Letters of a batch of words, and rows of an output batch.
_LETTERS, _ROWS = 1 << 17, 1 << 16
#: A broadcast table of words has so many letters at most.
_BROADCAST_LETTERS = 1 << 24
#: Primes below 2**31 and a base for each: a key is a polynomial in the base, modulo each prime.
_MODULI = ((2147483647, 911382323), (2147483629, 972663749), (2147483587, 1467483651), (2147483579, 1902347723))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a key stands for: a word with a wildcard, a word, a word with a letter left out.
_WILDCARD, _WORD, _DELETION = 0, 1, 2


def word_runs(text: Column) -> Column:
    """Runs of Latin letters, of which A to Z alone are lower-cased."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))


def without(word: Column, at: Column) -> Column:
    """word without the letter at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted(words: DataFrame, least_letters: int = 5, least: int = 3) -> DataFrame:
    """The distinct words (word) of enough letters and occurrences, with their number n. Counts are combined before the shuffle, so a frequent word is no hot key."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done, step = 1, base
    while done < n:  # the powers so far, times base ** done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % modulus
        done, step = done + more, step * step % modulus
    return out


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, kind, key, key) for every key of the words: for each place the word with a wildcard there and the word without the letter there, and the word itself.

    A key is 124 bits of polynomials of the letters, so a key of a word of m letters takes the same space and time whatever m
    is: those of one place less are sums of a head and a tail. Of equal letters in a row one is left out.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - starts[of]
    twin = (place > 0) & (letters == np.append(-1, letters[:-1]))
    found = []
    for modulus, base in _MODULI:
        power = _powers(base, modulus, int(sizes.max(initial=0)) + 1)[place]
        term = letters * power % modulus
        sums = np.append(0, np.cumsum(term))
        whole = (sums[starts + sizes] - sums[starts]) % modulus
        head = (sums[:-1] - sums[starts][of]) % modulus
        tail = (whole[of] - head - term) % modulus * pow(base, -1, modulus) % modulus
        found.append(np.concatenate([(whole[of] - term + power) % modulus, whole, ((head + tail) % modulus)[~twin]]))
    kinds = np.repeat(np.array([_WILDCARD, _WORD, _DELETION], np.int8), [len(letters), len(words), int((~twin).sum())])
    return np.concatenate([of, np.arange(len(words)), of[~twin]]), kinds, found[0] << 31 | found[1], found[2] << 31 | found[3]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n, place = batch.column("word"), batch.column("n").to_numpy(), batch.column("place").to_numpy()
        ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LETTERS, "right")))
            of, kind, a, b = keys_of(words.slice(at, end - at).to_pylist())
            of += at
            for i in range(0, len(of), _ROWS):
                own = slice(i, i + _ROWS)
                cols = [pa.array(x) for x in (a[own], b[own], kind[own], n[of[own]], place[of[own]])]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "kind", "n", "place"])
            at = end


def nearest_words(vocabulary: DataFrame) -> DataFrame:
    """place, n_near and best (n negated, place) of every word of vocabulary (word, n, place in code-point order) that has a near one.

    Words that differ in one letter share one key with a wildcard: a group of them has a size and two leading words, from which each
    member has its number of near words and the best of them. A word that is another one without a letter stands in the group
    of that deletion: it counts the deletions, and each of them has it. A group has at most as many rows as letters
    fit at its places, so none is hot.
    """
    rows = vocabulary.mapInArrow(released(_keys), "a long, b long, kind byte, n long, place long")
    group = Window.partitionBy("a", "b")
    order = group.orderBy("kind", F.desc("n"), "place")
    first = F.first(F.struct("kind", (-F.col("n")).alias("n"), "place")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    second = F.lead(F.struct((-F.col("n")).alias("n"), "place")).over(order)
    met = rows.select("kind", "place", F.count("*").over(group).alias("size"), F.row_number().over(order).alias("rank"), first.alias("first"), second.alias("second"))
    met = met.where((F.col("size") > 1) & (F.col("first.kind") != _DELETION))
    best = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.struct("first.n", "first.place"))
    near = F.when(F.col("kind") == _DELETION, F.lit(1).cast("long")).otherwise(F.col("size") - 1)
    return met.groupBy("place").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """place and root, what following up (place, up) ends at. Each round follows twice as far."""
    roots = materialise(forms.select("place", F.col("up").alias("root")), "variants-roots")
    n = roots.count()
    while True:
        step = materialise(lookup(roots, roots.select(F.col("place").alias("root"), F.col("root").alias("top")), "root", "left", n), "variants-step")
        if not step.where("top is not null").limit(1).count():
            discard(step)
            return roots
        further = materialise(step.select("place", F.coalesce("top", "root").alias("root")), "variants-roots")
        discard(step, roots)
        roots = further


def group_variants(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """For every word of words (word, n): word, form, root, n, n_near, form_n.

    Words are near if they differ by one letter inserted, deleted or replaced. The form of a word is its near word of largest
    n, the smallest in code-point order on ties, if that n is at least ratio times its own, else null. root is what following
    the forms ends at, the word itself if it has none; as n grows by ratio at each step, there are few steps and no circle.
    n_near is the number of near words.

    See nearest_words for the method: a word of m letters makes at most 2 * m + 1 rows of fixed size, which are shuffled once.
    Words are known by their places in code-point order, and a form that very many words have is met by lookup. Keys are
    124-bit hashes, taken as equal only for equal letters. Memory of a task is in proportion to its longest word.

    words must be distinct; null words are left out, and a null n counts as 0. With ratio at most 1 forms could go in
    circles, so it must be above. An empty table gives an empty result; other columns are ignored.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    known = words.select(words["word"], F.coalesce(words["n"], F.lit(0)).cast("long").alias("n")).where(F.col("word").isNotNull())
    every = placed(known, [F.col("word")], "variants-words")
    near = materialise(every.select("word", "n", "place").transform(nearest_words), "variants-near")
    joined = every.join(near, "place", "left")
    fits = -F.col("best.n") >= ratio * F.greatest("n", F.lit(1))
    out = joined.select("word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.place")).alias("up"), F.when(fits, -F.col("best.n")).alias("form_n"))
    out = materialise(out, "variants-forms")
    roots = last_forms(out.where("up is not null").select("place", "up"))
    size = out.agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("letters")).first()
    unique = size["rows"] if (size["letters"] or 0) <= _BROADCAST_LETTERS else max(size["rows"], BROADCAST_ROWS + 1)
    led = materialise(out.join(roots, "place", "left").withColumn("root", F.coalesce("root", "place")), "variants-led")
    led = lookup(led, out.select(F.col("place").alias("up"), F.col("word").alias("form")), "up", "left", unique)
    led = materialise(led, "variants-named") if unique > BROADCAST_ROWS else led
    named = lookup(led.drop("place", "up").withColumnRenamed("root", "place"), out.select("place", F.col("word").alias("root")), "place", "left", unique)
    discard(near, roots)
    return named.select("word", "form", "root", "n", "n_near", "form_n")
