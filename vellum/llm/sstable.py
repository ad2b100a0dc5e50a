r"""Token ids in sorted-string-table shards.

Documents are dealt over shards by range of doc_id and written in ascending order, each shard by one task as a stream of records:

    data blocks   entries of (shared, added, value length: varints; added key bytes; value), zstd-compressed, of about BLOCK_BYTES before it
    index block   for each data block: its last key, offset, size and the crc32 of its content
    filter block  number of hashes, then the bits of a Bloom filter over the keys
    footer        64 bytes: magic, id width, documents, ids, offsets and sizes of index and filter

A key is doc_id as 8 bytes, big-endian with the sign bit turned, so that bytes sort as numbers; a null doc_id has the empty key and comes first. A value is the ids of a document with the
end id 0, little-endian. Spark's text writer stores the records, whatever file system the shared folder is on, and puts one newline byte behind each; offsets count it. Failed tasks are
written anew by Spark's commit protocol. The reader uses nothing but the files.

Null text is empty: one id, the end. Repeated doc_ids give an entry each, in the order of their texts. An empty table gives no entries.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import slices, table, texts
from vellum.llm.tokens import SLICE_BYTES, default_path, encoder
from vellum.session import scratch_path, written

MAGIC, FOOTER = b"VSSTAB01", struct.Struct("<8sIQQQQQQ4x")
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
END_ID = 0


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Makes a shard's records from entries in ascending order; holds one block, the index and the keys' hashes."""

    def __init__(self, width: int) -> None:
        self._width, self._at, self._block, self._last, self._size = width, 0, [], b"", 0
        self._index: list[bytes] = []
        self._keys: list[bytes] = []
        self._ids = 0
        self._zip = zstandard.ZstdCompressor(level=1)

    def _record(self, data: bytes) -> bytes:
        self._at += len(data) + 1
        return data

    def _flush(self) -> bytes:
        raw = b"".join(self._block)
        data = self._zip.compress(raw)
        self._index.append(_varint(len(self._last)) + self._last + struct.pack("<QQI", self._at, len(data), zlib.crc32(raw)))
        self._block, self._size = [], 0
        return self._record(data)

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = 0
        if self._block:
            while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
                shared += 1
        self._block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self._last, self._size = key, self._size + len(value)
        self._keys.append(key)
        self._ids += len(value) // self._width
        if self._size >= BLOCK_BYTES:
            yield self._flush()

    def close(self) -> Iterator[bytes]:
        if self._block:
            yield self._flush()
        bits = np.zeros(max(64, -(-len(self._keys) * BLOOM_BITS // 8) * 8), np.uint8)
        for k in self._keys:
            bits[_bloom_places(k, len(bits))] = 1
        index_at, index = self._at, b"".join(self._index)
        yield self._record(index)
        bloom_at, bloom = self._at, bytes([BLOOM_HASHES]) + np.packbits(bits, bitorder="little").tobytes()
        yield self._record(bloom)
        yield FOOTER.pack(MAGIC, self._width, len(self._keys), self._ids, index_at, len(index), bloom_at, len(bloom))


class Shard:
    """Reads a shard: all entries in order, or one by filter, index and block."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.documents, self.ids, index_at, index_size, bloom_at, bloom_size = FOOTER.unpack(data[-1 - FOOTER.size : -1])
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self._data, self._bloom = data, data[bloom_at : bloom_at + bloom_size]
        self._keys, self._blocks, at = [], [], 0
        index = data[index_at : index_at + index_size]
        while at < len(index):
            n, at = _read_varint(index, at)
            self._keys.append(index[at : at + n])
            self._blocks.append(struct.unpack_from("<QQI", index, at + n))
            at += n + 20

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, crc = self._blocks[block]
        raw = zstandard.ZstdDecompressor().decompress(self._data[at : at + size])
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {block} is damaged")
        key, at = b"", 0
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            added, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + added]
            yield key, raw[at + added : at + added + n]
            at += added + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self._blocks)):
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        bits = 8 * (len(self._bloom) - 1)
        return all(self._bloom[1 + p // 8] >> p % 8 & 1 for p in _bloom_places(key, bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: none, one, or several where the key was repeated."""
        if not self.may_hold(key):
            return []
        out = []
        for block in range(bisect.bisect_left(self._keys, key), len(self._blocks)):
            got = [v for k, v in self._entries(block) if k == key]
            out += got
            if self._keys[block] > key:
                break
        return out


def _writer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end, shard, any_ = END_ID.to_bytes(enc.width, "little"), Writer(enc.width), False
        for part in slices(batches, SLICE_BYTES):
            any_ = True
            out = [r for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts(part.column(1)))) for r in shard.add(key_of(doc_id), ids + end)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if any_:
            for r in shard.close():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary())], ["value"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the shards of documents (doc_id, text) into a new folder."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer), "value binary").select(F.col("value").cast("string")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("long")
    return spark.read.format("binaryFile").load(f"{path}/part-*").filter("length > 0").select(number.alias("shard"), "content")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard, at, rows = Shard(data), 0, []
            for key, value in shard:
                ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                rows.append((number, id_of(key), at, len(ids), zlib.crc32(ids)))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each entry in the shards; start counts the ids of all entries before. Only a row per shard goes through one task."""
    rows = written(_files(spark, path).mapInArrow(_parsed, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "entries")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array<long>) of the given documents, by filter and binary search in each shard."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                shard = Shard(data)
                rows = [(i, np.frombuffer(v, f"<u{shard.width}").tolist()) for i in doc_ids for v in shard.get(key_of(i))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(found, "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write(table(spark, sf_dir, "documents"), path, default_path())
    return read_back(spark, path)
