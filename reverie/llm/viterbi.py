"""Token counts of a unigram tokenizer by Viterbi over Aho-Corasick matches, without building the tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The mark that stands for a space in the pieces, and how much worse than the worst piece an unknown character scores.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
_KEPT = 700_000
_LONGEST = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the pieces of the best segmentation, with the tokenizer's own tie rules.

    Positions are filled from left to right; among the pieces that end at one, the best sum of scores wins, and of equal
    sums the piece that starts first. A character with no piece of its own is an unknown of the lowest score less
    UNKNOWN_PENALTY; unknowns in a row are one token, or with byte fallback a token for each of their bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.score = {p: s for p, s in vocabulary if p}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for p, s in self.score.items():
            self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in self.score for b in range(256))
        self.separable = not any(SPACE in p.lstrip(SPACE) for p in self.score)  # no piece runs on past a word's end
        self.known: dict[str, tuple[int, float]] = {}

    def best(self, unit: str) -> tuple[int, float]:
        """(tokens, score) of one unit that no piece runs across the ends of."""
        n = len(unit)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.matches.iter(unit):
            ends[last + 1].append((last + 1 - length, score))
        total, came = [0.0] * (n + 1), [(0, False)] * (n + 1)
        for end in range(1, n + 1):
            found, own = None, False
            for start, score in ends[end]:
                own |= start == end - 1
                if found is None or total[start] + score > found or (total[start] + score == found and start < came[end][0]):
                    found, came[end] = total[start] + score, (start, False)
            if not own and (found is None or total[end - 1] + self.unknown > found):
                found, came[end] = total[end - 1] + self.unknown, (end - 1, True)
            total[end] = found
        tokens, at, run = 0, n, False
        while at:
            start, unknown = came[at]
            if unknown and self.byte_fallback:
                tokens += len(unit[start:at].encode("utf-8", "surrogatepass"))
            elif not (unknown and run):
                tokens += 1
            at, run = start, unknown
        return tokens, total[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a whole text: a space mark before it, spaces replaced by marks."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.separable:
            return self.best(marked)
        # where no piece runs on past a mark, a mark after a word begins a unit of its own
        units = marked.split(SPACE)[1:]
        if "" in units:
            joined, run = [], 0
            for u in units:
                run += 1
                if u:
                    joined.append(SPACE * run + u)
                    run = 0
            units = [*joined, *([SPACE * run] if run else [])]
        else:
            units = [SPACE + u for u in units]
        known, tokens, score = self.known, 0, 0.0
        for u in units:
            got = known.get(u)
            if got is None:
                got = self.best(u)
                if len(u) <= _LONGEST:
                    if len(known) >= _KEPT:
                        known.clear()
                    known[u] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


@lru_cache(maxsize=2)
def counter(path: str, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(load_vocabulary(path), byte_fallback)


def _run(path: str, byte_fallback: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, byte_fallback).count
        for batch in batches:
            got = [count(t.as_py()) for t in batch.column("text")]
            cols = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, model_path: str | None = None, byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of every whole text under the unigram reading of a vocabulary file.

    A narrow pass: no shuffle; each worker keeps the automaton and a bounded table of words. Null and empty texts have no
    tokens and score 0. Repeated rows and null ids are counted like any others; long texts and long words are read in full.
    An empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(_run(model_path or default_path(), byte_fallback), "doc_id long, n_tokens long, score double")
