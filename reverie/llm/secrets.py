"""Secret scans with built-in functions: pattern matches, and high-entropy windows of candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. kind -> (pattern, group that must be long enough, its least length).
BASE = {
    "assign": (
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class EntropyClass:
    """Candidate strings of one character class, and the entropy (bits a character) from which a window of them counts.

    alphabet holds every character that pattern matches; they are ASCII.
    """

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-Fa-f]{24,}", _DIGITS + "abcdefABCDEF", 24, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", _UPPER + _LOWER + _DIGITS + "+/_=-", 24, 4.0),
)


@dataclass(frozen=True)
class AllowList:
    """What is no secret: candidates that match one of the patterns as a whole, and the words, at which candidates are cut."""

    patterns: tuple[str, ...] = (
        r"[A-Za-z]+",  # words without a digit or sign
        r"[0-9]+",
        r"[A-Za-z]+([_/-][A-Za-z]*)*",  # identifiers and paths of words
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # identifiers by version 4 and the like
        r"[-_=+/]+",
    )
    words: tuple[str, ...] = field(default=("EXAMPLE", "example", "0123456789", "abcdefghijkl", "ABCDEFGHIJKL"))

    def suppressed(self, c: Column) -> Column:
        whole = "|".join(f"(?:{p})" for p in self.patterns)
        return c.rlike(rf"\A(?:{whole})\z")

    def blanked(self, text: Column) -> Column:
        """The text with every word of the list replaced by as many spaces, so that places stay and no candidate runs over one."""
        for w in self.words:
            text = F.replace(text, F.lit(w), F.lit(" " * len(w)))
        return text


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_STEP = 512


def running(values: Column) -> Column:
    """Of an array of numbers, the sum of those before each; in blocks, so that the cost of building the array does not grow with its square."""

    def sums(xs: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")), lambda b: F.slice(values, b * _STEP + 1, _STEP))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    whole = _let(blocks, lambda bs: F.flatten(F.zip_with(bs, sums(F.transform(bs, total)), lambda b, base: F.transform(sums(b), lambda x: x + base))))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Matches of pattern as array<struct<start, value>>; starts in code points.

    The pieces between matches and the matches themselves, laid one after another, are the text, so a match starts where the
    lengths before it end. Texts without a match are scanned once.
    """
    none = F.array().cast("array<struct<start:int,value:string>>")

    def placed(values: Column) -> Column:
        def by_gaps(gaps: Column) -> Column:
            before = running(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.length(g) + F.length(v)))
            return _let(before, lambda at: F.transform(values, lambda v, i: F.struct((F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), v.alias("value"))))

        return _let(F.split(text, pattern, -1), by_gaps)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, placed(values)).otherwise(none))


#: Scale of the integer c * log2(c) table: sums are exact, so thresholds do not depend on the order of additions.
SCALE = 1_000_000


def _terms(window: int) -> list[int]:
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def entropy_limit(window: int, bits: float) -> int:
    """A window's entropy is log2(window) - sum(c log2 c) / window; it is at least bits where the scaled sum is at most this."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


_SPANS = "array<struct<start:int,end:int>>"


def _window_spans(codes: Column, c: EntropyClass, width: int, n_longs: int) -> Column:
    """Merged spans of the high-entropy windows of one block of character codes, in one pass of incremental counts.

    The state holds the count of every character of the alphabet in the window, width bits each, side by side in a few longs,
    and the sum of n log2 n over them. A step adds the character that enters, takes out the one that leaves, and corrects
    the sum by two table entries, whatever the length of the block.
    """
    terms = _terms(c.window)
    up = F.array(*(F.lit(b - a) for a, b in zip(terms, [*terms[1:], 0])))
    down = F.array(*(F.lit(a - b) for a, b in zip([0, *terms[:-1]], terms)))
    limit, one, mask = entropy_limit(c.window, c.bits), F.lit(1).cast("bigint"), (1 << width) - 1

    def place(code: Column) -> Column:
        return F.call_function("shiftleft", one, code.bitwiseAND(F.lit(15)) * width)

    def held(acc: Column, code: Column) -> Column:
        long = F.coalesce(*(F.when(F.shiftright(code, 4) == j, acc[f"c{j}"]) for j in range(n_longs)))
        return F.call_function("shiftright", long, code.bitwiseAND(F.lit(15)) * width).bitwiseAND(F.lit(mask)).cast("int")

    def step(acc: Column, i: Column) -> Column:
        came, gone = F.get(codes, i), F.get(codes, i - c.window)  # gone is null until the window is full
        change = F.get(up, held(acc, came)) + F.when(gone.isNotNull(), F.get(down, held(acc, gone))).otherwise(0)
        total = F.when(came.eqNullSafe(gone), acc["sum"]).otherwise(acc["sum"] + change)
        return _let(total, lambda now: counted(acc, i, came, gone, now))

    def counted(acc: Column, i: Column, came: Column, gone: Column, total: Column) -> Column:
        def count(j: int) -> Column:
            more = F.when(F.shiftright(came, 4) == j, acc[f"c{j}"] + place(came)).otherwise(acc[f"c{j}"])
            return F.when(F.shiftright(gone, 4) == j, more - place(gone)).otherwise(more)

        low, on = i - (c.window - 1), (i >= c.window - 1) & (total <= limit)
        pushed = F.when(on & (acc["end"] > 0) & (low > acc["end"]), F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"])
        start = F.when(on & ((acc["end"] == 0) | (low > acc["end"])), low).otherwise(acc["start"])
        end = F.when(on, i + 1).otherwise(acc["end"])
        return F.struct(*(count(j).alias(f"c{j}") for j in range(n_longs)), total.alias("sum"), start.alias("start"), end.alias("end"), pushed.alias("spans"))

    zero = F.struct(*(F.lit(0).cast("bigint").alias(f"c{j}") for j in range(n_longs)), F.lit(0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast(_SPANS).alias("spans"))
    last = lambda acc: F.when(acc["end"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["spans"])
    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, last)


def entropy_spans(value: Column, c: EntropyClass) -> Column:
    """Merged spans [start, end) of the windows of value, a string of the class, whose entropy is at least c.bits.

    The string is cut into blocks that overlap by a window less one character, each is passed once with incremental counts,
    and spans that touch are merged. A character costs the same in a string of any length.
    """
    width = c.window.bit_length()
    per = min(16, 63 // width)
    table = [0] * 128
    for k, ch in enumerate(c.alphabet):
        table[ord(ch)] = k // per << 4 | k % per
    codes = F.transform(F.split(value, ""), lambda ch: F.get(F.array(*map(F.lit, table)), F.ascii(ch)))

    def by_blocks(all_codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_codes) - c.window) / _STEP).cast("int"))

        def block(b: Column) -> Column:
            own = F.slice(all_codes, b * _STEP + 1, _STEP + c.window - 1)
            spans = _let(own, lambda x: _window_spans(x, c, width, -(-len(c.alphabet) // per)))
            return F.transform(spans, lambda s: F.struct((s["start"] + b * _STEP).alias("start"), (s["end"] + b * _STEP).alias("end")))

        return _let(F.flatten(F.transform(starts, block)), _merged)

    return F.when(F.length(value) >= c.window, _let(codes, by_blocks)).otherwise(F.array().cast(_SPANS))


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch as one."""
    starts = F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i - 1)["end"] < s["start"], F.lit(True)))
    ends = F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i + 1)["start"] > s["end"], F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), e["end"].alias("end")))


#: Spans that are walked together, and code points of a block of text.
_CHUNK, _BLOCK = 256, 1024


def _walked(items: Column, end: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(item, reach) of the items in order, nulls left out, where reach is the greatest end before the item, 0 at first.

    Items are walked in chunks, which begin at the greatest end of all chunks before, so an item costs the same in a list of any
    length but for the few numbers of the chunks.
    """

    def by_chunks(chunks: Column) -> Column:
        reaches = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.coalesce(F.array_max(F.transform(c, end)), F.lit(0))))))
        zero = lambda reach: F.struct(reach.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(F.greatest(acc["at"], end(x)).alias("at"), _let(made(x, acc["at"]), lambda y: F.when(y.isNotNull(), F.concat(acc["out"], F.array(y))).otherwise(acc["out"])).alias("out"))
        walk = lambda c, reach: F.aggregate(c, zero(reach), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, F.slice(reaches, 1, F.size(chunks)), walk))

    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _CHUNK).cast("int"))
    chunks = F.transform(starts, lambda k: F.slice(items, k * _CHUNK + 1, _CHUNK))
    return F.when(F.size(items) > 0, _let(chunks, by_chunks)).otherwise(F.array().cast(f"array<{kind}>"))


def scan_secrets(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: AllowList = AllowList(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets in whole texts: doc_id, text, and spans array<struct<kind, start, end>> by start, then kind as listed; with keep, also those columns as the struct kept.

    Base kinds are assign, access and hex (see BASE). The method adds entropy spans: strings of a character class, unless the
    allow list suppresses them, are passed once with incremental counts, and windows of high Shannon entropy, merged where
    they touch, are spans. Entropy spans that lie within a base span are not repeated.

    Everything is a projection of built-in functions: no shuffle, no Python, and a lost task is one split read again.
    Null text counts as empty and has no spans. Null doc_ids and repeated rows are scanned like any others. Starts and ends
    are code points, ends exclusive. An empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *([F.struct(*(docs[c] for c in keep)).alias("kept")] if keep else []))
    texts = texts.withColumns({f"_{kind}": _base_spans(rank, kind) for rank, kind in enumerate(BASE)})
    texts = texts.withColumn("_blanked", allow.blanked(F.col("text")))
    added = [_entropy_class_spans(rank, c, allow) for rank, c in enumerate(classes, len(BASE))]
    texts = texts.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in BASE)))
    texts = texts.withColumn("_added", F.concat(*added))
    # base spans come first of equal starts, so an added one lies within a base one if the greatest of their ends so far covers it
    base_end = lambda s: F.when(s["rank"] < len(BASE), s["end"]).otherwise(0)
    shown = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    every = _walked(F.array_sort(F.concat("_base", "_added")), base_end, lambda s, reach: F.when((s["rank"] < len(BASE)) | (s["end"] > reach), shown(s)), "struct<kind:string,start:int,end:int>")
    found = F.when(F.size("_added") > 0, every).otherwise(F.transform(F.array_sort("_base"), shown))
    return texts.select("doc_id", "text", found.alias("spans"), *(["kept"] if keep else []))


def _base_spans(rank: int, kind: str) -> Column:
    pattern, group, least = BASE[kind]
    kept = F.filter(matches(F.col("text"), pattern), lambda m: F.length(F.regexp_extract(m["value"], pattern, group)) >= least)
    return F.transform(kept, lambda m: _span(m["start"], m["start"] + F.length(m["value"]), kind, rank))


def _entropy_class_spans(rank: int, c: EntropyClass, allow: AllowList) -> Column:
    candidates = F.filter(matches(F.col("_blanked"), c.pattern), lambda m: ~allow.suppressed(m["value"]))
    return F.flatten(F.transform(candidates, lambda m: F.transform(entropy_spans(m["value"], c), lambda s: _span(m["start"] + s["start"], m["start"] + s["end"], c.kind, rank))))


def _span(start: Column, end: Column, kind: str, rank: int) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """The text with each span (kind, start, end, by start) replaced by its kind; spans that begin inside an earlier one are covered by it.

    The text is cut into blocks of code points once, and the stretches between spans are put together from them, so time grows
    with the text and the number of spans and not with their product. A null text, or null spans, stay as they are.
    """
    before, after = mark.split("{}")
    stretch = lambda s, reach: F.when(s["start"] >= reach, F.struct(reach.alias("a"), s["start"].alias("b"), F.concat(F.lit(before), s["kind"], F.lit(after)).alias("mark")))
    kept = _walked(spans, lambda s: s["end"], stretch, "struct<a:int,b:int,mark:string>")
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("a"), F.length(text).alias("b"), F.lit("").alias("mark"))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        at = lambda i: F.coalesce(F.get(blocks, F.floor(i / _BLOCK).cast("int")), F.lit(""))
        inner = F.floor(b / _BLOCK).cast("int") - F.floor(a / _BLOCK).cast("int") - 1
        across = F.concat(
            F.substring(at(a), a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, F.floor(a / _BLOCK).cast("int") + 2, F.greatest(F.lit(0), inner)), ""), F.substring(at(b), F.lit(1), b % _BLOCK)
        )
        return F.when(b <= a, F.lit("")).when(inner < 0, F.substring(at(a), a % _BLOCK + 1, b - a)).otherwise(across)

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    clean = _let(blocks, lambda own: F.array_join(F.transform(F.concat(kept, F.array(last)), lambda p: F.concat(cut(own, p["a"], p["b"]), p["mark"])), ""))
    return F.when(F.size(spans) > 0, clean).otherwise(text)
