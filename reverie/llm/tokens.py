"""Byte-level BPE ids of whole texts, with every distinct piece encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of the table; those of the text of a task (32 MB in token files) mostly fit, so few are encoded again.
_KEPT = 800_000
_LONGEST = 64
_BYTES_AT_ONCE = 1 << 20
_LINES = 1 << 15
#: A piece at the start of a text or line, which no space begins, and a newline, as they are marked while a text is cut.
_HEAD, _LINE = "\x01", "\x00"
#: Texts that are not cut: runs of white space, spaces at the ends, and characters but space and newline that are or may count as white space.
_ODD = r"  | \n|\n |\n\n|\A[ \n]|[ \n]\z|[\x00\x01\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARKS = ".,;:!?*&$%#|()[]{}<>/+=~^-"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others, in order, for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of the tokenizers library as little-endian unsigned 32-bit numbers.

    Byte-level BPE never merges across pre-tokens; a space before a non-space always begins one, and a single newline is one.
    So texts are cut at such spaces and newlines, and the distinct pieces of some megabytes of text are looked up in a table;
    those not seen before go to the library, all in one call. The table is begun anew when it is full and does not keep
    long pieces, so memory is bounded; a task that is done lets it go by forget(). Texts with other white space, or with the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *("".join(f"\\x{{{ord(c):x}}}" for c in a) for a in added)])
        self.lines = Tokenizer(self.tokenizer.model)  # the same model, for pre-tokens that stand on lines of their own
        self.lines.pre_tokenizer = Split(_LETTERS[10], "isolated")
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # piece -> its row below
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, the number of ids of each piece).

        Letters and the marks behind them are pre-tokens. Distinct ones that are not known yet are set on lines, which the model
        encodes together, and are told apart by the newlines between them; pieces are then put together from them.
        """
        index: dict[str, int] = {}
        known, old = self.known, len(self.starts)
        parts, count, others = [], np.ones(len(pieces), np.int64), []
        for i, p in enumerate(pieces):
            own = p[1:] if p[:1] == _HEAD else p
            word = own.rstrip(_MARKS)
            if word.isalpha():
                if own is not p:
                    parts.append(old + index.setdefault(word, len(index)))
                elif (row := known.get(word)) is None:
                    parts.append(old + index.setdefault(f" {word}", len(index)))
                else:
                    parts.append(row)
                if len(word) < len(own):
                    parts.append(old + index.setdefault(own[len(word) :], len(index)))
                    count[i] = 2
            else:
                others.append("\n" if p == _LINE else own if own is not p else f" {p}")
                parts.append(-len(others))
        lines = list(index)
        got, n = self._encode_lines(lines) if len(self.newline) == 1 else self._joined(self.whole(lines))
        more, m = self._joined(self.whole(others))
        flat, new = np.concatenate([self.flat, got, more]), np.concatenate([n, m])
        starts, sizes = np.concatenate([self.starts, len(self.flat) + np.cumsum(new) - new]), np.concatenate([self.sizes, new])
        at = np.array(parts, np.int64)
        at = np.where(at < 0, old + len(lines) - 1 - at, at)  # the others stand behind the lines
        ids = _gather(flat, starts[at], sizes[at])
        return ids, np.bincount(np.repeat(np.arange(len(pieces)), count), weights=sizes[at], minlength=len(pieces)).astype(np.int64)

    def _joined(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, "<u4"), *rows]), np.array([len(r) for r in rows], np.int64)

    def _encode_lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(lines), _LINES):
            mapped = ("\n".join(lines[at : at + _LINES]) + "\n").encode().decode("latin-1").translate(_LETTERS)
            got = np.array(self.lines.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(got == self.newline[0])
            ids.append(np.delete(got, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _rows(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, sizes) of pieces, known or new; the new are kept."""
        rows = list(map(self.known.get, pieces))
        new = [p for p, r in zip(pieces, rows) if r is None]
        flat, starts, sizes = self.flat, self.starts, self.sizes
        if new:
            ids, n = self._learn(new)
            first = len(starts)
            starts = np.concatenate([starts, len(flat) + np.cumsum(n) - n])
            sizes, flat = np.concatenate([sizes, n.astype(np.int32)]), np.concatenate([flat, ids])
            fresh = iter(range(first, first + len(new)))
            rows = [next(fresh) if r is None else r for r in rows]
            if len(self.known) > _KEPT or len(flat) > 16 * _KEPT:
                self.forget()
            else:
                self.flat, self.starts, self.sizes = flat, starts, sizes
                self.known.update((p, first + i) for i, p in enumerate(new) if len(p) <= _LONGEST)
        at = np.array(rows, np.int64)
        return flat, starts[at], sizes[at]

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, self.odd)
        plain = texts.filter(pc.invert(odd))
        pieces = pc.split_pattern(pc.binary_join_element_wise(_HEAD, pc.replace_substring(plain, "\n", f" {_LINE} {_HEAD}"), ""), " ")
        coded = pc.dictionary_encode(pieces.flatten())
        flat, starts, sizes = self._rows(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        ids, ends = _gather(flat, starts[code], sizes[code]), np.cumsum(sizes[code])
        cuts = np.append(0, ends)[pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()]
        own = iter(np.split(ids, cuts[:-1]) if len(cuts) else [])
        rest = iter(self.whole(texts.filter(odd).to_pylist()))
        return [next(rest) if o else next(own) for o in odd.to_pylist()]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; nulls are empty. Some megabytes of text are in work at once, or one text."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + _BYTES_AT_ONCE, "right")))
            part = texts.slice(at, end - at)
            empty = sizes[end - 1] == before
            yield from ([np.zeros(0, "<u4")] * len(part) if empty else self._cut_filled(part))
            at = end

    def _cut_filled(self, texts: pa.Array) -> list[np.ndarray]:
        full = pc.greater(pc.binary_length(texts), 0)
        own = iter(self._cut(texts.filter(full)))
        return [next(own) if f else np.zeros(0, "<u4") for f in full.to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
