"""Hierarchical language identification: the family first, then one-versus-one linear machines within it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
DIMS = 1 << 12
_CHUNK = 1 << 20


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), lang)


def vector(text: str) -> np.ndarray:
    """Hashed counts of byte pairs, triples and quadruples of the lower-cased text, square-rooted and scaled to length one; long texts are counted in chunks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIMS)
    for at in range(0, len(raw), _CHUNK):
        b = raw[at : at + _CHUNK + 3].astype(np.uint32)
        grams = b[:-1] << 8 | b[1:]
        for n in (2, 3, 4):
            if len(b) >= n:
                own = grams[: _CHUNK]
                counts += np.bincount(((own * np.uint32(2654435761) + np.uint32(n * 40503)) >> 20).astype(np.int64), minlength=DIMS)
            if len(b) > n and n < 4:
                grams = (grams[: len(b) - n] * np.uint32(16777619)) ^ b[n:]
    x = np.sqrt(counts)
    return x / max(np.linalg.norm(x), 1e-12)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by conjugate gradients on its active rows (Newton steps without a matrix)."""
    z = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = (cost * np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))).astype(np.float32)
    w = np.zeros(z.shape[1], np.float32)
    for _ in range(15):
        on = y * (z @ w) < 1
        if not on.any():
            break
        a, c = z[on], weight[on]
        r = a.T @ (c * y[on]) - (w + a.T @ (c * (a @ w)))
        p, d, rr = r.copy(), np.zeros_like(w), r @ r
        if rr < 1e-10:
            break
        for _ in range(steps):
            q = p + a.T @ (c * (a @ p))
            step = rr / (p @ q)
            d += step * p
            r -= step * q
            new = r @ r
            if new < 1e-10:
                break
            p, rr = r + (new / rr) * p, new
        w = w + d
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """Pairs of classes with their machines: between families, and between the languages of each family."""

    languages: list[str]
    families: dict[str, list[str]]
    between: dict[tuple[str, str], tuple[np.ndarray, float]]

    def _vote(self, x: np.ndarray, classes: list[str]) -> tuple[str, float]:
        """One-versus-one: most wins, then the largest sum of margins, then the smaller name; with a confidence from the winner's closest call."""
        wins, sums, least = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), dict.fromkeys(classes, np.inf)
        for a, b in combinations(classes, 2):
            w, bias = self.between[a, b]
            m = float(x @ w + bias)
            wins[a if m >= 0 else b] += 1
            for c, own in ((a, m), (b, -m)):
                sums[c] += own
                least[c] = min(least[c], own)
        best = min(classes, key=lambda c: (-wins[c], -sums[c], c))
        return best, float(1 / (1 + np.exp(-3 * least[best])))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        x = vector(text)
        fam, sure = self._vote(x, sorted(self.families))
        lang, own = self._vote(x, self.families[fam])
        return lang, min(1.0, sure * own)


def fit(rows: list[tuple[np.ndarray, str]]) -> LanguageModel:
    languages = sorted({lang for _, lang in rows})
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(family(lang), []).append(lang)
    x = np.array([v for v, _ in rows], np.float32).reshape(len(rows), DIMS)
    of_lang = np.array([lang for _, lang in rows])
    of_family = np.array([family(lang) for _, lang in rows])

    def between(of: np.ndarray, classes: list[str]) -> dict[tuple[str, str], tuple[np.ndarray, float]]:
        out = {}
        for a, b in combinations(sorted(classes), 2):
            own = (of == a) | (of == b)
            w, bias = linear_svm(x[own], np.where(of[own] == a, np.float32(1), np.float32(-1)))
            out[a, b] = (w, bias)
        return out

    pairs = between(of_family, list(families))
    for langs in families.values():
        pairs |= between(of_lang, langs)
    return LanguageModel(languages, families, pairs)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [vector(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(v, pa.binary())], names=["lang", "v"])


def train_language_model(docs: DataFrame, per_language: int = 600, max_rows: int = 20_000, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most per_language distinct labelled texts of every language, fewer if all languages together had over max_rows, chosen by hash.

    Every language with a labelled text is learned, however rare. Whole texts become vectors of DIMS numbers in the tasks;
    only the chosen vectors reach the driver (16 KB each, so max_rows bounds its memory). Copies of a text count once. Rows
    with null or empty text, without a letter or without a language are no training rows; no rows at all give a model that
    answers und.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count"))
    per_language = max(1, min(per_language, max_rows // max(1, counts.count())))
    # about twice the wanted share of the texts by hash first, and copies once, so that the window below ranks a bounded number of rows
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("count"))
    some = rows.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "h"])
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)
    got = ranked.select("text", "lang").mapInArrow(_vectors, "lang string, v binary").collect()
    return fit(sorted(((np.frombuffer(r["v"], np.float32), r["lang"]) for r in got), key=lambda r: (r[1], r[0].tobytes())))


def _predictor(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return released(run)


def identify_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, lang_pred and score (0 to 1) of every whole text.

    A narrow pass: no shuffle. Null and empty texts and texts without a letter are und with score 0, as is everything under
    a model without languages. Repeated rows and null ids are predicted like any others; ties go to the smaller name. Very
    long texts are counted whole, a chunk of bytes at a time. An empty table gives an empty result. Columns that are not
    kept may have any name; keep must not hold a column of text_col's name, text, lang_pred or score, which raises ValueError.
    """
    if clash := {c.lower() for c in keep} & {"text", "lang_pred", "score", text_col.lower()}:
        raise ValueError(f"columns of the result's names cannot be kept: {', '.join(sorted(clash))}")
    texts = docs.select(*(docs[c] for c in keep), docs[text_col].cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double")
