"""Packing along a space-filling curve.

Each document's token ids give a hashed vector: its share of each id, projected by fixed pseudo-random signs to DIMENSIONS numbers. Scaled to whole numbers they are a point in a cube, and the point's
place on the Hilbert curve is the document's key. Documents are range-sorted by key (doc_id among equal keys, so copies of one text spread over tasks) and packed in that order: the next document begins where the last
one ended, cut wherever a sequence is full. So only a task's last sequence is not full; it is padded to the next power of two.

Null text is empty: one id, the end. Repeated rows are documents of their own. An empty table gives no pieces.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import slices, table, texts
from vellum.llm.tokens import SLICE_BYTES, default_path, encoder
from vellum.session import written

LENGTH, END_ID = 1024, 0
DIMENSIONS, BITS, SCALE = 3, 10, 6.0
#: A sequence's number is its task's, times this, plus its place in the task.
TASK_STRIDE = 1 << 33


def signs(n: int) -> np.ndarray:
    """The projection: DIMENSIONS pseudo-random signs for each of n ids."""
    x = (np.arange(n * DIMENSIONS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(np.int8).reshape(n, DIMENSIONS) * 2 - 1


def hilbert(points: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of points (rows of DIMENSIONS numbers under 2 to the BITS), as int64."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(BITS - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            up = (axes[i] & bit) != 0
            swap = np.where(up, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(up, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(BITS - 1, 0, -1):
        turn = np.where((axes[-1] >> level & 1) != 0, turn ^ ((1 << level) - 1), turn)
    out = np.zeros_like(axes[0])
    for level in range(BITS - 1, -1, -1):
        for a in axes:
            out = out << 1 | (a ^ turn) >> level & 1
    return out


def keys(ids: list[np.ndarray], table_: np.ndarray) -> np.ndarray:
    """The documents' keys; none of them is without ids."""
    starts = np.cumsum([0, *(len(x) for x in ids[:-1])])
    sums = np.add.reduceat(table_[np.concatenate(ids)], starts, axis=0, dtype=np.int64)
    share = sums / np.array([len(x) for x in ids])[:, None]
    return hilbert(((np.tanh(SCALE * share) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zipped, table_ = encoder(path), zstandard.ZstdCompressor(level=1), None
        end = END_ID.to_bytes(enc.width, "little")
        for part in slices(batches, SLICE_BYTES):
            table_ = signs(1 << 16 if enc.width == 2 else 1 << 20) if table_ is None else table_
            raw = [x + end for x in enc.encode(texts(part.column(1)))]
            key = keys([np.frombuffer(x, enc.dtype) & np.array(len(table_) - 1, enc.dtype) for x in raw], table_)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array([zipped.compress(x) for x in raw], pa.binary()), pa.array([enc.width] * len(raw), pa.int32())], ["doc_id", "key", "ids", "width"])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    sequence, filled, opened = TaskContext.get().partitionId() * TASK_STRIDE, 0, []
    closed: list[tuple] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(8)], [x.split()[0] for x in _PIECES.split(", ")])

    def close() -> None:
        padded = 1 << (filled - 1).bit_length()
        closed.extend((*r, padded) for r in opened)
        opened.clear()

    for part in slices(batches):
        for doc_id, data, width in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
            ids = np.frombuffer(unzip.decompress(data), f"<u{width}").astype("<u4")
            at = 0
            while at < len(ids):
                n = min(LENGTH - filled, len(ids) - at)
                opened.append((doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids), sequence, filled))
                at, filled = at + n, filled + n
                if filled == LENGTH:
                    close()
                    sequence, filled = sequence + 1, 0
        if closed:
            yield batch(closed)
            closed.clear()
    if opened:
        close()
        yield batch(closed)


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and padded_length."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_encoded(tokenizer), "doc_id long, key long, ids binary, width int")
    dealt = written(rows, "encoded").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.select("doc_id", "ids", "width").mapInArrow(_packed, _PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_path())
