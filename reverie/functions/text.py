"""Text rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def holds_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def velocity_class(label: Column) -> Column:
    """fast if the lower-cased label holds a fast word anywhere (so breakfast is fast), else slow, else medium."""
    low = F.lower(label)
    return F.when(holds_any(low, C.FAST_WORDS), "fast").when(holds_any(low, C.SLOW_WORDS), "slow").otherwise("medium")


def collapsed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def before_dot(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def after_slash(label: Column) -> Column:
    return F.substring_index(label, "/", -1)


def stem(path: Column) -> Column:
    """File name without folders and its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.coalesce(x, F.lit("Unknown"))), ", ")


def audio_events(text: Column) -> Column:
    """Names of the bracketed event tokens in a transcript, in dictionary order."""
    found = F.array(*(F.when(F.contains(text, F.lit(f"<|{e}|>")), e) for e in C.AUDIO_EVENTS))
    return F.filter(found, lambda x: x.isNotNull())


def says_yes(response: Column) -> Column:
    return F.startswith(F.upper(F.trim(response)), F.lit("YES"))


def first_choice(response: Column) -> Column:
    """The first digit 1 to 3 of a response, null if there is none."""
    return F.nullif(F.regexp_extract(response, "[1-3]", 0), F.lit("")).cast("int")


def leaks(value: Column) -> Column:
    out = F.lit(False)
    for p in C.LEAK_PATTERNS:
        out = out | value.rlike(p)
    return F.coalesce(out, F.lit(False))


def task_id(n: Column) -> Column:
    return F.format_string("t_%02d", n)


def folded_emotion(label: Column) -> Column:
    out = F.lower(label)
    for a, b in C.EMOTION_FOLD.items():
        out = F.when(F.lower(label) == a, F.lit(b)).otherwise(out)
    return out


def emotion_direction(emotion: Column, positive: Iterable[str] = C.POSITIVE_EMOTIONS, negative: Iterable[str] = C.NEGATIVE_EMOTIONS) -> Column:
    return F.when(emotion.isin(*positive), "positive").when(emotion.isin(*negative), "negative").otherwise("neutral")


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers, of any length: by how many digits they have without leading zeros, then by the digits."""
    number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    keyed = F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p))
    return F.array_join(keyed, "\u0000")


def schema_hash(names: Column) -> Column:
    """First six hexadecimal digits of the SHA-256 of the sorted, comma-joined column names."""
    return F.substring(F.sha2(F.array_join(F.array_sort(names), ","), 256), 1, 6)


def human_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1e9, F.concat(F.format_number(n / 1e9, 1), F.lit(" GB")))
        .when(n >= 1e6, F.concat(F.format_number(n / 1e6, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / 1e3, 1), F.lit(" KB")))
    )
