"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exclusive_bases, materialise, released
from .tokens import default_path, encoder

TIERS = (256, 512, 1024, 2048)
_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("tier", pa.int32()),
    ("offset", pa.int64()),
    ("local_seq", pa.int64()),
    ("tier_rank", pa.int64()),
    ("part", pa.int64()),
]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tier int, offset long, local_seq long, tier_rank long, part long"


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length)]) that hold every id of documents of these lengths exactly once.

    A document is cut into full windows of the longest tier; what remains is an item, routed to the shortest tier that
    holds it. Tiers are packed from the longest down: the longest item opens a window of its tier, and its gap is filled
    with the longest items of shorter tiers that fit; where none fits, the shortest item left is cut so that the window is
    full. Only the last window can run out of items; it is cut into powers of two, so no window needs padding.
    """
    longest, windows, pool = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        full = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, full, longest)]
        if n > full:
            pool.append((n - full, doc, full))
    pool.sort()
    while pool:
        n, doc, start = pool.pop()
        tier = next(t for t in tiers if t >= n)
        window, gap = [(doc, start, n)], tier - n
        while gap and pool:
            fits = bisect_right(pool, (gap, 1 << 62, 0))
            if fits:
                n, doc, start = pool.pop(fits - 1)
            else:
                whole, doc, start = pool.pop(0)
                n = gap
                insort(pool, (whole - gap, doc, start + gap))
            window.append((doc, start, n))
            gap -= n
        windows += [(tier, window)] if not gap else _powers_of_two(window, tier - gap)
    return windows


def _powers_of_two(window: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    out, pieces = [], window[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        got, need = [], size
        while need:
            doc, start, n = pieces.pop()
            if n > need:
                pieces.append((doc, start + need, n - need))
                n = need
            got.append((doc, start, n))
            need -= n
        out.append((size, got))
    return out


def tier_ranks(windows: list[tuple[int, list[tuple[int, int, int]]]], dealt: dict[int, int]) -> list[int]:
    """The number of each window among those of its length in this task, those of most attention work (squares of piece lengths) first; dealt counts on from buffer to buffer."""
    work = [-sum(n * n for _, _, n in pieces) for _, pieces in windows]
    ranks = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (work[i], i)):
        tier = windows[i][0]
        ranks[i] = dealt[tier] = dealt.get(tier, -1) + 1
    return ranks


def _packer(path: str, eos: int, tiers: tuple[int, ...], buffer_tokens: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([eos], "<u4").tobytes()
    fields = [*_FIELDS, ("ids", pa.list_(pa.int64()))] if with_ids else _FIELDS

    def packed(docs: list[tuple[int, bytes]], seq: int, dealt: dict[int, int], part: int) -> tuple[pa.RecordBatch, int]:
        windows = plan_windows([len(ids) // 4 for _, ids in docs], tiers)
        rows = []
        for k, ((tier, pieces), rank) in enumerate(zip(windows, tier_ranks(windows, dealt))):
            at = 0
            for doc, start, n in pieces:
                doc_id, ids = docs[doc]
                own = ids[4 * start : 4 * (start + n)]
                row = (doc_id, start, n, zlib.crc32(own), len(ids) // 4, tier, at, seq + k, rank, part)
                rows.append((*row, np.frombuffer(own, "<u4").astype(np.int64)) if with_ids else row)
                at += n
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays(cols, names=[n for n, _ in fields]), seq + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        docs, held, seq, dealt = [], 0, 0, {}
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                ids = ids.tobytes() + end
                docs.append((doc_id, ids))
                held += len(ids) // 4
                if held >= buffer_tokens:
                    out, seq = packed(docs, seq, dealt, part)
                    docs, held = [], 0
                    yield out
        if docs:
            yield packed(docs, seq, dealt, part)[0]
        coder.forget()

    return released(run)


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    eos_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = 1 << 20,
    step_tokens: int = 1 << 16,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs whole documents into windows of several context sizes without padding.

    Each task encodes the documents of its own partition, in order, and packs them a buffer at a time (see plan_windows),
    so nothing but the small table of pieces is written and no text moves. Window numbers become global by prefix sums over
    the tasks' counts. Step groups of about step_tokens are balanced over the whole table: all windows, the longest first
    and those of a task by attention work, are dealt to the groups in turn, which takes no more than counts by task and length.

    Null text counts as empty; an empty document is its end id alone. Null doc_ids and repeated rows are packed like any
    others. A very long document is cut into full windows as it is encoded; an empty table gives no pieces. Other columns
    are ignored. Buffers hold buffer_tokens and one more document.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's length),
    step_group, and ids if with_ids.
    """
    run = _packer(tokenizer_path or default_path(), eos_id, tiers, buffer_tokens, with_ids)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = materialise(texts.mapInArrow(run, _SCHEMA + (", ids array<long>" if with_ids else "")), "pack-pieces")
    # a row per task, and per task and length: safe to broadcast
    bases = exclusive_bases(pieces.groupBy("part").agg((F.max("local_seq") + 1).alias("seqs")), "part", seq_base="seqs")
    lengths = pieces.groupBy("part", "tier").agg((F.max("tier_rank") + 1).alias("n"))
    tokens = lengths.agg(F.sum(F.col("n") * F.col("tier"))).first()[0] or 0
    before = Window.orderBy(F.desc("tier"), "part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = lengths.select("part", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("dealt"))
    group = F.pmod(F.col("dealt") + F.col("tier_rank"), F.lit(max(1, round(tokens / step_tokens))))
    return pieces.join(F.broadcast(bases), "part").join(F.broadcast(dealt), ["part", "tier"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("seq_base") + F.col("local_seq")).alias("sequence_id"),
        "offset",
        "tier",
        group.alias("step_group"),
        *(["ids"] if with_ids else []),
    )
