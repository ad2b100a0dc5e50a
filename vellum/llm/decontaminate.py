r"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised on their UTF-8 bytes: A-Z to lower case, every separator to a space, one space between words. The automaton holds each window of 10 consecutive
item words with a space on either side (an item of fewer words is one window) and runs once over each whole text. Matches map back to words and to code points of the original text.

The automaton is built from the benchmark's distinct windows on the driver. Their size is checked: a benchmark of more than PART_BYTES is cut into parts by item, each with an automaton of its own
and a scan of its own, and the hits of the parts are merged by document.

Null and empty texts have no words and no hits. An item without words has no window. Repeated items and rows count as they stand: equal item ids are one item. A null item id reads "null".
Empty tables give no rows or no hits.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import slices, table, texts

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes some hundred times as much memory.
PART_BYTES = 256 << 10
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def automaton(items: list[tuple[str, bytes]]) -> ahocorasick.Automaton:
    """Maps each window to (its number of words, the ids of its items)."""
    windows: dict[bytes, set[str]] = {}
    sizes: dict[bytes, int] = {}
    for name, text in items:
        w = words(text)
        for at in range(max(1, len(w) - WINDOW + 1) if w else 0):
            key = b" " + b" ".join(part := w[at : at + WINDOW]) + b" "
            windows.setdefault(key, set()).add(name)
            sizes[key] = len(part)
    out = ahocorasick.Automaton()
    for key, names in windows.items():
        out.add_word(key.decode("latin-1"), (sizes[key], tuple(sorted(names))))
    if windows:
        out.make_automaton()
    return out


def scan(text: bytes, auto: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the hit runs of words (first, one past the last) and the items found."""
    w = words(text)
    if not w or not len(auto):
        return len(w), [], set()
    line = b" " + b" ".join(w) + b" "
    hits = list(auto.iter(line.decode("latin-1")))
    if not hits:
        return len(w), [], set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in hits]).tolist()
    names = {n for _, (_, ids) in hits for n in ids}
    return len(w), merged(sorted((e - k, e) for e, (_, (k, _)) in zip(last, hits))), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, runs: list[tuple[int, int]]) -> str:
    """start:end of the runs in code points of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    chars = lambda n: len(text[:n].decode("utf-8", "replace"))
    return ",".join(f"{chars(at[a][0])}:{chars(at[b - 1][1])}" for a, b in runs)


def _parts(benchmark: DataFrame) -> list[list[tuple[str, bytes]]]:
    """The items in parts of at most PART_BYTES (or one item). They come to the driver part by part."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).toLocalIterator()
    parts, size = [[]], 0
    for r in rows:
        if parts[-1] and size + len(r["text"]) > PART_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((r["name"], bytes(r["text"])))
        size += len(r["text"])
    return parts


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
_RAW = "doc_id long, text binary, n_words long, runs array<struct<a:int,b:int>>, items array<string>"
_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _built(shared) -> ahocorasick.Automaton:
    """One automaton per worker and broadcast."""
    if shared.value is not _AUTOMATA.get("items"):
        _AUTOMATA.clear()
        _AUTOMATA.update({"items": shared.value, "auto": automaton(shared.value)})
    return _AUTOMATA["auto"]


def _digest(text: bytes, runs: list[tuple[int, int]], names: set[str]) -> tuple:
    return sum(b - a for a, b in runs), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(runs), spans(text, runs) if runs else ""


def _report(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _built(shared)
        for part in slices(batches):
            rows = []
            for t in texts(part.column(1)):
                n, runs, names = scan(t, auto)
                rows.append((n, *_digest(t, runs, names)))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def _clean(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _built(shared)
        at = None
        for part in slices(batches):
            at = part.schema.get_field_index("text") if at is None else at
            keep = [not scan(t, auto)[1] for t in texts(part.column(at).cast(pa.binary()))]
            yield part.filter(pa.array(keep, pa.bool_()))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of each row of documents (doc_id, text); benchmark has item_id and text."""
    spark = docs.sparkSession
    parts = _parts(benchmark)
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if len(parts) == 1:
        return source.mapInArrow(_report(spark.sparkContext.broadcast(parts[0])), _SCHEMA)
    keyed = source.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    found = None
    for items in parts:
        shared = spark.sparkContext.broadcast(items)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = _built(shared)
            for part in slices(batches):
                got = [scan(t, auto) for t in texts(part.column(1))]
                some = [i for i, g in enumerate(got) if g[1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some, pa.int64())), part.column(2).take(pa.array(some, pa.int64())), pa.array([[{"a": a, "b": b} for a, b in got[i][1]] for i in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([sorted(got[i][2]) for i in some], pa.list_(pa.string()))],
                    ["doc_id", "row", "runs", "items"],
                )

        one = keyed.mapInArrow(hits, "doc_id long, row int, runs array<struct<a:int,b:int>>, items array<string>")
        found = one if found is None else found.unionByName(one)
    merged_hits = found.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    joined = keyed.alias("d").join(merged_hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row") == F.col("h.row")), "left").select("d.doc_id", "d.text", "h.runs", "h.items")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for t, runs, names in zip(texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                rows.append((len(words(t)), *_digest(t, merged(sorted((r["a"], r["b"]) for r in runs or [])), set(names or []))))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])

    return joined.mapInArrow(report, _SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no window of the benchmark, whole and in place: a filter per part of the benchmark."""
    for items in _parts(benchmark):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
b AS (SELECT item_id, {_SPLIT} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS k, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - {WINDOW - 2}))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win FROM (SELECT d.doc_id, d.ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
hw AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits) h, (SELECT unnest(range({WINDOW})) AS j) t WHERE j < k GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
