"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in at most 4 bits meet in the middle: some word lies within 2 bits of both. So each emits all words of that ball, a shuffle on the
words brings partners together, and colliding pairs are deduplicated and verified. The plain ball has 2,081 words; the split form here needs 131. Cut the 64 bits in three
blocks: of the three pairs of blocks one holds at most 2 of the 4 differences (each difference lies in two of the pairs), so over these 42 or 43 bits the half radius is 1. Every fingerprint
emits, for each pair of blocks, the 43 or 44 words within 1 bit; colliding pairs are verified over all 64 bits. Nothing is lost: the split form finds each pair within 4 bits.

Groups can't make it quadratic. Equal fingerprints are merged first. A bucket of more than BUCKET fingerprints is not paired: its members emit the plain ball of 2,081 words, where all that
share a word are within 4 bits of each other, so a star to the least of them has their whole connection. Fingerprints stay distributed all the time.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and ties give rows of their own with equal values. Rows without doc_id get a fingerprint, and a component id only
if a row with an id is in their component. An empty table gives an empty result.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import LOWER, slices, table, texts
from vellum.llm.graph import components
from vellum.session import written

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Low bit and width of the three blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Most fingerprints in a bucket that are compared with each other; larger ones take the plain ball.
BUCKET = 64


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip((ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())], "<u8")
    for at in range(0, len(hashes), 65535):
        part = hashes[at : at + 65535].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        fps = np.array([fingerprint(t) for t in texts(part.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split_words(fps: DataFrame) -> DataFrame:
    """(word, fp): the 131 words of each fingerprint. The block left out holds the pair's number instead."""
    parts = []
    for k, (low, width) in enumerate(BLOCKS):
        out = ((1 << width) - 1) << low
        keep = ~out & ((1 << 64) - 1)
        parts += [(keep, (k + 1) << low)] + [(keep, (k + 1) << low ^ 1 << j) for j in range(64) if keep >> j & 1]
    table_ = F.array(*(F.struct(F.lit(_signed(keep)).cast("long").alias("keep"), F.lit(_signed(x)).cast("long").alias("x")) for keep, x in parts))
    return fps.select("fp", F.explode(table_).alias("e")).select(F.col("fp").bitwiseAND(F.col("e.keep")).bitwiseXOR(F.col("e.x")).alias("word"), "fp")


def _ball_words(fps: DataFrame) -> DataFrame:
    """(word, fp): the 2,081 words within 2 bits of each fingerprint."""
    one = [1 << j for j in range(64)]
    masks = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]
    return fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("word"), "fp")


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        yield b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)


def _edges(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64())], ["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by word: pairs within the radius of buckets up to BUCKET; of larger ones the members, with v null. Holds one batch and a bucket's start."""
    word, fp, hot = np.empty(0, np.int64), np.empty(0, np.int64), None

    def pairs(word: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(word) < 2:
            return
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[starts, len(word)])
        large = np.repeat(sizes > BUCKET, sizes)
        if large.any():
            yield _edges(np.unique(fp[large]), None)
            word, fp = word[~large], fp[~large]
        found = []
        for s in range(1, min(BUCKET, len(word))):
            near = np.flatnonzero(word[s:] == word[:-s])
            if not len(near):
                break
            a, b = fp[near], fp[near + s]
            apart = np.bitwise_count((a ^ b).view(np.uint64))
            ok = (apart <= RADIUS) & (apart > 0)
            found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]))
        if found and (all_ := np.concatenate(found, axis=1)).size:
            u, v = np.unique(all_, axis=1)
            yield _edges(u, v)

    for w, f in _sorted_runs(batches):
        if hot is not None:
            n = int(np.searchsorted(w, hot, side="right"))
            if n:
                yield _edges(np.unique(f[:n]), None)
            w, f = w[n:], f[n:]
            if not len(w):
                continue
            hot = None
        word, fp = np.concatenate([word, w]), np.concatenate([fp, f])
        if not len(word):
            continue
        last = int(np.searchsorted(word, word[-1]))
        yield from pairs(word[:last], fp[:last])
        word, fp = word[last:], fp[last:]
        if len(word) > BUCKET:
            yield _edges(np.unique(fp), None)
            hot, word, fp = int(word[0]), word[:0], fp[:0]
    yield from pairs(word, fp)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by word and fingerprint: each fingerprint with the least of its word."""
    word = least = None
    for w, f in _sorted_runs(batches):
        if not len(w):
            continue
        first = np.r_[True, w[1:] != w[:-1]]
        start = f[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]
        if word is not None and w[0] == word:
            start = np.where(w == word, least, start)
        word, least = w[-1], start[-1]
        other = start != f
        if other.any():
            u, v = np.unique(np.stack([start[other], f[other]]), axis=1)
            yield _edges(u, v)


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints fp: edges of the same components as all pairs within RADIUS."""
    found = written(_split_words(fps).repartition("word").sortWithinPartitions("word").mapInArrow(_verified, "u long, v long"), "links")
    large = written(found.filter("v IS NULL").select(F.col("u").alias("fp")).distinct(), "large")
    stars = _ball_words(large).repartition("word").sortWithinPartitions("word", "fp").mapInArrow(_stars, "u long, v long")
    return found.filter("v IS NOT NULL").unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of documents (doc_id, text)."""
    prints = written(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(links(groups.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of documents, one of each component: that with the least doc_id (of repeated ids the first text). Rows without doc_id can't be named and stay."""
    keep = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("_id").orderBy(F.xxhash64("_row.text"))
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id")).join(keep.withColumnRenamed("doc_id", "_id"), "_id", "left_semi")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
