"""Token ids in Arrow stream files of fixed-size-list batches."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclusive_bases, released, shuffle_partitions
from .tokens import default_path, encoder

_BATCH = 256
_MANIFEST = pa.schema([("part", pa.int64()), ("stem", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
#: Bytes of text that go into one pair of files.
FILE_BYTES = 32 << 20
_DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sequence_schema(seq_len: int, dtype: pa.DataType, about: dict) -> pa.Schema:
    return pa.schema(
        [("input_ids", pa.list_(pa.field("item", dtype, False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), seq_len))],
        metadata={"tokens": json.dumps(about)},
    )


class SequenceFile:
    """Random access to the sequences of one stream file.

    All record batches but the last hold as many sequences, so sequence i is in batch i // per_batch. A local file is mapped,
    and the arrays below are views of its pages: zero copy. Any other store is read through its Arrow file system, forward
    and one batch at a time; a step back begins anew.
    """

    def __init__(self, uri: str):
        fs, path = _place(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._open = lambda: pa.ipc.open_stream(pa.memory_map(path) if local else fs.open_input_file(path))
        self._stream, self._at, self._held = self._open(), -1, None
        self.about = json.loads(self._stream.schema.metadata[b"tokens"])
        self.seq_len = self._stream.schema.field("input_ids").type.list_size
        self._mapped = list(self._stream) if local else None
        first = self._batch(0)
        self.per_batch = first.num_rows if first is not None else 1

    def _batch(self, i: int) -> pa.RecordBatch | None:
        if self._mapped is not None:
            return self._mapped[i] if i < len(self._mapped) else None
        if i < self._at:
            self._stream, self._at, self._held = self._open(), -1, None
        while self._at < i:
            try:
                self._held = self._stream.read_next_batch()
            except StopIteration:
                return None
            self._at += 1
        return self._held

    def __len__(self) -> int:
        n = i = 0
        while (batch := self._batch(i)) is not None:
            n, i = n + batch.num_rows, i + 1
        return n

    def _row(self, i: int) -> tuple[pa.RecordBatch, int]:
        return self._batch(i // self.per_batch), i % self.per_batch

    def sequence(self, i: int) -> np.ndarray:
        batch, row = self._row(i)
        return batch.column(0).values.to_numpy(zero_copy_only=True)[row * self.seq_len : (row + 1) * self.seq_len]

    def mask(self, i: int) -> pa.BooleanArray:
        batch, row = self._row(i)
        return batch.column(1).values.slice(row * self.seq_len, self.seq_len)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids start to start + n of the file, batch by batch."""
        per = self.per_batch * self.seq_len
        while n:
            values = self._batch(start // per).column(0).values.to_numpy(zero_copy_only=True)[start % per : start % per + n]
            yield values
            start, n = start + len(values), n - len(values)


def _writer(path: str, uri: str, eos: int, pad: int, seq_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        wide = max(coder.vocab_size, eos + 1, pad + 1) > 1 << 16
        dtype, np_dtype = (pa.uint32(), np.uint32) if wide else (pa.uint16(), np.uint16)
        about = {"eos_id": eos, "pad_id": pad, "seq_len": seq_len, "vocab_size": coder.vocab_size}
        schema = sequence_schema(seq_len, dtype, about)
        fs, root = _place(uri)
        fs.create_dir(root, recursive=True)
        stem, per = f"part-{part:06d}-{uuid.uuid4().hex[:12]}", _BATCH * seq_len  # of this attempt alone
        held, n_held, total, n_docs = [], 0, 0, 0

        def put(out: pa.ipc.RecordBatchStreamWriter, values: np.ndarray) -> None:
            rows = -(-len(values) // seq_len)
            ids = np.full(rows * seq_len, pad, np_dtype)
            ids[: len(values)] = values
            mask = np.arange(rows * seq_len) < len(values)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), schema)]
            out.write_batch(pa.RecordBatch.from_arrays(cols, schema=schema))

        with fs.open_output_stream(f"{root}/{stem}.tokens.arrows") as a, fs.open_output_stream(f"{root}/{stem}.docs.arrows") as b, pa.ipc.new_stream(a, schema) as out, pa.ipc.new_stream(b, _DOC_SCHEMA) as index:
            for batch in batches:
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                    ids = np.append(ids, np.uint32(eos)).astype(np_dtype)
                    rows.append((doc_id, total, len(ids)))
                    total += len(ids)
                    held.append(ids)
                    n_held += len(ids)
                    if n_held >= per:
                        values = np.concatenate(held)
                        for at in range(0, n_held - n_held % per, per):
                            put(out, values[at : at + per])
                        held, n_held = [values[n_held - n_held % per :]], n_held % per
                n_docs += len(rows)
                if rows:
                    index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_DOC_SCHEMA))
            if n_held:
                put(out, np.concatenate(held))
        coder.forget()
        yield pa.RecordBatch.from_pylist([{"part": part, "stem": stem, "n_docs": n_docs, "n_tokens": total}], schema=_MANIFEST)

    return released(run)


def write_token_files(
    docs: DataFrame, uri: str, tokenizer_path: str | None = None, eos_id: int = 0, pad_id: int = 0, seq_len: int = 2048, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes whole documents in ascending doc_id order into stream files under uri; returns the manifest (part, stem, n_docs, n_tokens), a row per file.

    A range partition of doc_id becomes one pair of files: stem.tokens.arrows, record batches of 256 sequences of seq_len
    ids (16 bits where the vocabulary allows it, else 32) with a bit mask, and stem.docs.arrows, an index of (doc_id,
    start, n_tokens). The last sequence of a file is padded with pad_id and masked there. Without n_files their number is
    that of the text's bytes over FILE_BYTES.

    Every attempt of a task writes under a stem of its own, and the manifest, kept in uri/manifest, names the pair of the
    attempt that Spark committed: a task may run again at any time, and a pair is never of two attempts. Files that the manifest
    does not name are left over from lost attempts.

    Null text is empty: the end id alone. Null doc_ids come first, rows of one doc_id stand in the order of their texts'
    hashes, repeated rows are kept; a very long text is encoded whole, on its own; an empty table writes nothing of any
    length. Other columns are ignored.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    if n_files is None:
        n_files = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // FILE_BYTES)
    ordered = texts.repartitionByRange(n_files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    run = _writer(tokenizer_path or default_path(), uri, eos_id, pad_id, seq_len)
    manifest = ordered.mapInArrow(run, "part long, stem string, n_docs long, n_tokens long")
    path = f"{uri.rstrip('/')}/manifest"
    manifest.write.parquet(path)
    return docs.sparkSession.read.schema(manifest.schema).parquet(path)


def _reader(uri: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(uri)
        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist()):
                tokens = SequenceFile(f"{uri}/{stem}.tokens.arrows")
                with fs.open_input_file(f"{root}/{stem}.docs.arrows") as f:
                    for rows in pa.ipc.open_stream(f):
                        starts, lengths = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                        crcs = []
                        for start, n in zip(starts, lengths):
                            crc = 0
                            for values in tokens.span(start, n):
                                crc = zlib.crc32(values.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(0), pa.array([base + s for s in starts], pa.int64()), rows.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                        )

    return run


def read_token_files(spark: SparkSession, uri: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. files: what write_token_files returned."""
    placed = files.join(F.broadcast(exclusive_bases(files, "part", base="n_tokens")), "part")  # one row per file
    dealt = placed.select("part", "stem", "base").repartition(max(1, shuffle_partitions(spark)), "part")
    return dealt.mapInArrow(_reader(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")
