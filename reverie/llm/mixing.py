"""Mixing sources to target weights by systematic sampling within each source. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, placed

#: Expected copies are counted in units of 2**-48, so that sums of them are exact.
_UNIT = 1 << 48
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null. Every run becomes one letter, so nothing is gathered in an array."""
    begun = F.regexp_replace(text, rf"\A[{_SPACE}]+", "")
    return F.coalesce(F.length(F.regexp_replace(begun, rf"[^{_SPACE}]++[{_SPACE}]*+", "x")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with the target of each: share of all sizes dealt by weight, none above most times its own size.

    Weights repeat along the sources by code point, null last. A level is a target for each unit of weight; sources whose limit
    lies below it take their limit, and what they leave raises the level for the others, until it stays. Each round is one
    aggregate of the sources, of which two numbers come back.
    """
    by_place = F.array(*(F.lit(float(w)) for w in weights))
    weighed = placed(sources, [F.col("source").asc_nulls_last()], "mix-sources").withColumn("weight", F.get(by_place, (F.col("place") % len(weights)).cast("int")))
    limit = most * F.col("source_size").cast("double")
    total = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, (rest, weight) = -1.0, (total, None)
    while True:
        full = limit <= level * F.col("weight")
        left = weighed.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        rest, weight = total - (left["taken"] or 0.0), left["weight"]
        if not weight or rest / weight <= level:
            break
        level = rest / weight
    open_target = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
    return weighed.withColumn("target", F.when(limit <= level * F.col("weight"), limit).otherwise(F.least(limit, open_target))).drop("place", "weight")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    keep: Sequence[str] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each document stands in a mix of its sources: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source expects target / source_size copies. Within a source the expected copies are summed in the order
    of size, then doc_id; one offset, drawn from the seed and the source's name, is added; and a document is taken once for each
    whole number that its stretch of the sum crosses. So the number of copies of any run of documents is within one of
    what is expected, and as neighbours have nearly equal sizes, a source's words come within about its longest document of
    its target. With most at 2, no document is taken more than twice.

    Sizes are words between ASCII white space. Places are global (see placed): a source of any size is dealt over many tasks, and
    only ids and sizes move, with the columns named in keep, which come back in a struct kept (emitted makes rows of
    them). Sums of expected copies are exact, so reruns agree.

    Null and empty texts have size 0: they are counted as documents and take nothing. Null doc_ids come first in the order; rows
    with the same id and size are interchangeable, and each repeated row is a document of its own. A null source is a
    source, the last. Weights must be positive. An empty table gives an empty result; other columns, also of the names used
    here, are ignored.
    """
    if min(weights) <= 0 or share < 0 or most < 0:
        raise ValueError("weights must be positive, share and most not negative")
    kept = [F.struct(*(docs[c] for c in keep)).alias("kept")] if keep else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), *kept)
    rows = placed(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], "mix-rows")
    per = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("first")), "mix-sizes")
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))), 1, 12)
    offset = F.conv(digest, 16, 10).cast("long")
    rate = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * float(_UNIT)), F.lit(0)).cast("long")
    of = targets(per, weights, share, most).select(F.col("source").alias("__s"), "source_size", "target", "first", rate.alias("rate"), offset.alias("offset"))
    of = F.broadcast(of) if per.count() <= BROADCAST_ROWS else of
    met = rows.join(of, F.col("source").eqNullSafe(F.col("__s")))

    def crossed(at: Column) -> Column:
        """Whole numbers up to the sum of the first so many documents of a source: at * rate + offset over the unit, by halves of the rate, which 64 bits hold for 2**38 documents."""
        low = F.shiftright(at * F.col("rate").bitwiseAND(F.lit((1 << 24) - 1)) + F.col("offset"), 24)
        return F.shiftright(at * F.shiftright("rate", 24) + low, 24)

    at = F.col("place") - F.col("first")
    out = met.withColumn("copies", crossed(at + 1) - crossed(at))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of the mix itself: every document as often as it is taken, with copy from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
