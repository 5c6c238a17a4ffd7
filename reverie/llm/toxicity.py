"""Toxicity by a support vector machine over a gap-weighted subsequence kernel of words, with Nyström landmarks."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import released

ALPHABET, LENGTH, SPAN, DECAY = 40, 4, 7, 0.5
_START = 1
_WIDTH, _STRIDE = 24, 16
_KEPT = 200_000
_ROWS = 4096
_CHARS = 1 << 21
_SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _code(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - ord("a") + 2
    return 28 + ord(ch) % (ALPHABET - 28) if ch.isalnum() else 0  # signs inside a word are gaps


def pieces(token: str) -> list[str]:
    """The word in a token: lower case, signs at its ends dropped; long ones as overlapping pieces."""
    word = _EDGES.sub("", token.lower())
    if len(word) <= _WIDTH:
        return [word] if word else []
    return [word[i : i + _WIDTH] for i in range(0, len(word) - _WIDTH + _STRIDE, _STRIDE)]


def tokens_of(text: str | None) -> list[str]:
    """Tokens at white space; three or more single characters in a row on a line also make one token together."""
    text = text or ""
    return text.split() + [re.sub(r"\s", "", m) for m in _SPELLED.findall(text)]


def encode(words: list[str]) -> np.ndarray:
    """Character codes after a start mark, padded with gaps so that every span fits."""
    out = np.zeros((len(words), 1 + _WIDTH + SPAN), np.int32)
    for row, w in zip(out, words):
        row[0] = _START
        row[1 : 1 + len(w)] = [_code(c) for c in w]
    return out


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(key of the subsequence that starts at each position, its weight); key 0 where a gap is part of it."""
    n = codes.shape[1] - SPAN
    for later in combinations(range(1, SPAN), LENGTH - 1):
        keys = codes[:, :n]
        whole = keys > 0
        for i in later:
            step = codes[:, i : i + n]
            keys = keys * ALPHABET + step
            whole &= step > 0
        yield np.where(whole, keys, 0), DECAY ** (later[-1] + 1 - LENGTH)


def features(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each word, the keys of its subsequences and their summed weights, scaled to length one."""
    out = []
    for at in range(0, len(codes), 512):
        every = [(k, np.full(k.shape, w)) for k, w in _subsequences(codes[at : at + 512])]
        keys, weights = np.concatenate([k for k, _ in every], 1), np.concatenate([w for _, w in every], 1)
        for k, w in zip(keys, weights):
            u, place = np.unique(k[k > 0], return_inverse=True)
            v = np.bincount(place, weights=w[k > 0], minlength=len(u))
            out.append((u, v / max(np.sqrt((v * v).sum()), 1e-12)))
    return out


class Landmarks:
    """The kernel between words and a few landmarks, over the subsequences of the landmarks alone."""

    def __init__(self, words: list[str]):
        rows = features(encode(words))
        self.keys = np.unique(np.concatenate([k for k, _ in rows])) if rows else np.zeros(0, np.int64)
        self.matrix = np.zeros((len(rows), len(self.keys)), np.float32)
        for row, (k, v) in zip(self.matrix, rows):
            row[np.searchsorted(self.keys, k)] = v

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.matrix)))
        if not len(self.keys):
            return out
        for row, (k, v) in zip(out, features(encode(words))):
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            hit = self.keys[at] == k
            row[:] = self.matrix[:, at[hit]] @ v[hit]
        return out


@dataclass
class ToxicityModel:
    """The machine's decision on a word is weights . phi(word) / |phi(word)| + bias: landmarks and Nyström map are folded into weights over subsequences."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    threshold: float
    slope: float

    @cached_property
    def weights(self) -> np.ndarray:
        out = np.zeros(ALPHABET**LENGTH, np.float32)
        out[self.keys] = self.values
        return out

    def words(self, words: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._some(words[at : at + _ROWS]) for at in range(0, len(words), _ROWS))])

    def _some(self, words: list[str]) -> np.ndarray:
        codes = encode(words)
        top, square = np.zeros(len(words)), np.zeros(len(words))
        for keys, w in _subsequences(codes):
            top += self.weights[keys].sum(1) * w
            square += (keys > 0).sum(1) * (w * w)
        out = np.full(len(words), -1.0)
        # repeats of a subsequence can only lengthen phi: exact lengths are needed where this bound is not low
        near = np.flatnonzero((top > 0) & (top / np.sqrt(np.maximum(square, 1e-12)) + self.bias > -1))
        for i, (keys, values) in zip(near, features(codes[near])):
            out[i] = max(-1.0, float(self.weights[keys] @ values) + self.bias)
        return out

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.slope * (margins - self.threshold)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps over its active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(30):
        on = y * (z @ w) < 1
        a = z[on] * (cost * weight[on])[:, None]
        new = np.linalg.solve(ridge + a.T @ z[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _varied(words: list[str], n: int, most: float = 0.7) -> list[str]:
    """The first n words, none of which is more alike to an earlier one than most."""
    gram, chosen = Landmarks(words), []
    alike = gram.matrix @ gram.matrix.T
    for i in range(len(words)):
        if len(chosen) < n and (not chosen or alike[i, chosen].max() <= most):
            chosen.append(i)
    return [words[i] for i in chosen]


def _stems(word: str) -> set[str]:
    return {word[:n] for n in (4, 5, 6)} | {word}


def fit(bags: Iterable[tuple[list[str], int]], n_landmarks: int = 192, cost: float = 4.0, rounds: int = 3, max_words: int = 3000, pool: int = 3, seed: int = 7) -> ToxicityModel:
    """Multiple-instance training: a toxic text has a toxic word, a clean one has none.

    Bounds of the training sample: max_words witness words, those in most toxic texts, and twice as many clean words, drawn
    at random; landmarks come from the first pool * n_landmarks witnesses.

    First witnesses are words whose stems occur in toxic texts beyond chance (a likelihood ratio against clean ones); then
    machine and witnesses are refined in turn: the best-scored words of toxic texts stay, and clean words that score
    high join the negative rows.
    """
    sets = [({sys.intern(p) for t in dict.fromkeys(tokens) for p in pieces(t)}, y) for tokens, y in bags]
    if len({y for _, y in sets}) < 2:
        rate = (sum(y for _, y in sets) + 0.5) / (len(sets) + 1)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0, -1.0 - float(np.log(rate / (1 - rate))), 1.0)
    rng = np.random.default_rng(seed)
    n1, n0 = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    seen = (Counter(), Counter())
    for words, y in sets:
        seen[y].update({s for w in words for s in _stems(w)})
    clean = sorted({w for words, y in sets if not y for w in words})

    def ratio(stem: str) -> float:
        a, b = seen[1][stem], seen[0][stem]
        n, p = a + b, n1 / (n1 + n0)
        if not n or a / n <= p:
            return 0.0
        return 2 * (a * np.log(a / (n * p)) + (b * np.log(b / (n * (1 - p))) if b else 0.0))

    tests = sum(1 for s, a in seen[1].items() if a + seen[0][s] >= 4)
    least = 2 * np.log(max(tests, 2)) + 1
    clean_set = set(clean)
    strength = {w: max(map(ratio, _stems(w))) for words, y in sets if y for w in words if w not in clean_set}
    witnesses = Counter(w for words, y in sets if y for w in words if strength.get(w, 0) >= least)
    if not witnesses:
        witnesses = Counter(max(strength, key=lambda w: (strength[w], w)) for _ in range(1)) if strength else Counter(["\0"])
    positive = [w for w, _ in sorted(witnesses.items(), key=lambda x: (-x[1], x[0]))][:max_words]
    negative = [clean[i] for i in rng.permutation(len(clean))[: 2 * max_words]] or [""]
    model = None
    for _ in range(rounds):
        # the landmarks: varied positive words, the commonest first, and the negative words most like them
        chosen = _varied(positive[: pool * n_landmarks], n_landmarks * 2 // 3)
        likeness = Landmarks(chosen).kernel(negative).max(1)
        chosen += [negative[i] for i in np.argsort(-likeness, kind="stable")[: n_landmarks - len(chosen)]]
        marks = Landmarks(chosen)
        values, vectors = np.linalg.eigh((marks.matrix @ marks.matrix.T).astype(np.float64))
        root = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # the Nyström map, K ** -1/2
        words = positive + negative
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        balance = np.where(y > 0, len(negative) / len(positive), 1.0) ** 0.5
        w, bias = _svm(marks.kernel(words) @ root, y, balance, cost)
        model = ToxicityModel(marks.keys, ((root @ w) @ marks.matrix).astype(np.float32), bias, 0.0, 4.0)
        margins = dict(zip(clean, model.words(clean)))
        hard = sorted(clean, key=lambda c: (-margins[c], c))[: max_words // 3]
        negative = list(dict.fromkeys(negative + hard))
        suspects = sorted(w for w, s in strength.items() if s >= least / 2)
        found = dict(zip(suspects, model.words(suspects))) if suspects else {}
        best = Counter()
        for words_of_bag, label in sets:
            own = [x for x in words_of_bag if x in found]
            if label and own:
                top = max(found[x] for x in own)
                best.update(x for x in own if found[x] >= max(0.0, top - 0.5))
        if best:
            positive = [x for x, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))][:max_words]
    every = sorted({w for words, _ in sets for w in words})
    margin = dict(zip(every, model.words(every)))
    bag = np.array([max((margin[w] for w in words), default=-1.0) for words, _ in sets])
    labels = np.array([y for _, y in sets])
    order = np.sort(np.unique(bag))
    cuts = np.concatenate([[order[0] - 0.1], (order[1:] + order[:-1]) / 2, [order[-1] + 0.1]])
    errors = np.array([((bag >= c) != labels).mean() for c in cuts])
    best_cuts = cuts[errors == errors.min()]
    return ToxicityModel(model.keys, model.values, model.bias, float(np.median(best_cuts)), 4.0)


def training_bags(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> Iterator[tuple[list[str], int]]:
    """A bounded sample of labelled texts: the rows of least hash in each class, of at most max_chars characters."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean))
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id")
    return ((tokens_of(r["text"]), int(r["toxic"])) for r in rows.collect())  # the texts of at most max_toxic + max_clean ids


def _scorer(model: ToxicityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    known: dict[str, float] = {}

    def margins(texts: list[str | None]) -> list[float]:
        tokens = [tokens_of(t) for t in texts]
        got = [list(map(known.get, ts)) for ts in tokens]
        new = dict.fromkeys(t for ts, ms in zip(tokens, got) if None in ms for t, m in zip(ts, ms) if m is None)
        cut = [(t, p) for t in new for p in pieces(t)]
        found = dict.fromkeys(new, -1.0)
        for (t, _), m in zip(cut, model.words([p for _, p in cut]).tolist()):
            found[t] = max(found[t], m)
        out = [max((found[t] if m is None else m for t, m in zip(ts, ms)), default=-1.0) if None in ms else max(ms, default=-1.0) for ts, ms in zip(tokens, got)]
        if len(known) > _KEPT:
            known.clear()
        known.update((t, m) for t, m in found.items() if len(t) <= 2 * _WIDTH)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, held, chars = [], [], 0
            for t in batch.columns[-1]:
                held.append(t.as_py())
                chars += len(held[-1] or "")
                if chars >= _CHARS:
                    got += margins(held)
                    held, chars = [], 0
            got += margins(held)
            scores = pa.array(model.score(np.array(got, float)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])
        known.clear()

    return released(run)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 3000, max_chars: int = 20_000) -> ToxicityModel:
    """Fits the machine on at most max_toxic + max_clean labelled texts of at most max_chars characters each.

    Rows with null ids, labels or texts are no training rows; with one class or none the model scores every text alike, by
    the share of toxic rows. If a doc_id is labelled more than once, one toxic label makes it toxic.
    """
    return fit(training_bags(docs, labels, max_toxic, max_clean, max_chars))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns and score (0 to 1): the most toxic word of the whole text decides.

    A narrow pass over the table: no shuffle. Null and empty texts have no word and score lowest; very long texts and long
    words are read in full, long words as overlapping pieces. Repeated rows and null ids are scored like any others.
    An empty table gives an empty result. Columns not in keep are ignored.
    """
    kept = docs.select(*(docs[c] for c in keep)).schema
    packed = docs.select(F.struct(*(docs[c] for c in keep)).alias("kept"), docs[text_col].cast("string").alias("scored"))
    out = packed.mapInArrow(_scorer(model), StructType([StructField("kept", kept), StructField("score", DoubleType())]))
    return out.select("kept.*", "score")
