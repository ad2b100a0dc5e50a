"""Operators with a state per document: functions of vellum.functions.rewrite over Arrow batches. Each row is worked on by itself, so texts never move."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import rewrite as R
from vellum.plans.dialect import spread
from vellum.plans.publish import native


def per_text(df: DataFrame, key: str, text: str, make: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows (key, ...) that make gives for each text; null text is empty. schema is that of what make's tuples hold."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in make(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], [key, *names])

    return spread(df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))).mapInArrow(run, f"{key} long, {schema}")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _changed(function: Callable[[str], str], where: str = "documents", key: str = "doc_id", text: str = "text"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return per_text(spark.read.parquet(f"{sf_dir}/{where}.parquet"), key, text, lambda t: [(function(t),)], "changed string")

    return run


native("STR-04 STR-24", "template_replacements", "Replacements by templates with groups and changes of case.")(_changed(lambda t: R.replace_all(r"\b([a-z])([a-z]+) ([a-z]+)\b", r"\U\1\E\2 \T\3\E", t)))
native("STR-13", "normalised_texts", "Texts in the composed normal form.", "SELECT doc_id, nfc_normalize(coalesce(text, '')) AS changed FROM documents")(_changed(R.normalised))
native("WIN-39 WIN-40 WIN-41", "rewrapped_texts", "Paragraphs filled to the width with the least squared differences.")(_changed(R.rewrapped))
native("HTM-40 HTM-42 HTM-45 HTM-46 HTM-52 HTM-53 HTM-54 HTM-55", "generated_pages", "Texts as HTML pages.")(_changed(R.to_html))
native("HTM-60 HTM-62", "styled_pages", "Pages under rules of style for classes.")(_changed(lambda t: R.with_css(t, {"ad": {"display": "none"}}), "pages", "page_id", "html"))


@native("WIN-14 WIN-15", "curly_quotes")
def curly_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is odd about quotes when they are made curly, by place; texts without quotes give no row."""
    return per_text(_documents(spark, sf_dir), "doc_id", "text", lambda t: R.curly_quotes(t)[1], "place int, why string")


@native("JOI-18 JOI-19 STR-50 STR-51 STR-52 STR-53", "document_differences")
def document_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that make a conversation's next turn of a role out of the one before: words and lines on both sides."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("old"))
    pairs = turns.join(before, ["conv_id", "turn"]).select("conv_id", F.to_json(F.struct("turn", "old", "text")).alias("both"))

    def made(text: str) -> list[tuple]:
        pair = json.loads(text)
        return [(pair["turn"], *x) for x in R.differences(pair.get("old") or "", pair.get("text") or "")]

    return per_text(pairs, "conv_id", "both", made, "turn int, old string, old_line int, new string, new_line int")


@native("STR-58", "character_names")
def character_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of the documents with its Unicode name, whether it lies beyond the first plane, and its count."""
    chars = _documents(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return per_text(chars, "n", "ch", lambda c: [(c, R.character_name(c), ord(c) > 0xFFFF)], "ch string, name string, beyond boolean")


@native("STR-59", "characters_by_name")
def characters_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters whose names have the words asked for."""
    asked = spark.createDataFrame([(1, "latin small letter grave"), (2, "em dash"), (3, "00E9"), (4, "x")], "id long, text string")
    return per_text(asked, "id", "text", lambda t: [(c, R.character_name(c)) for c in R.characters_named(t)], "ch string, name string")


@native("ARR-07 ARR-09 ARR-13", "stepped_tables")
def stepped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of documents in steps and back as a grid, with the first column filled to ten characters: number of rows and the grid's text."""

    def made(text: str) -> list[tuple]:
        rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.split("\n") if line.count(" | ") >= 2]
        if not rows:
            return []
        back = R.stepped_to_grid(R.grid_to_stepped(rows))
        return [(len(back), "\n".join("|".join(r) for r in R.adjusted_column(back, 0, 10)))]

    return per_text(_documents(spark, sf_dir), "doc_id", "text", made, "n_rows int, grid string")


@native("WIN-07", "basic_fixup")
def basic_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the basic fix-up would change: line, kind, start and end."""
    return per_text(_documents(spark, sf_dir), "doc_id", "text", R.fixup_findings, "line_no int, kind string, start_col int, end_col int")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book fixture's texts: doc_id, text."""
    from vellum.plans import base, dialect

    text = lambda d: base.ctes(base.book(d)) + "SELECT doc_id, listagg(line, char(10)) WITHIN GROUP (ORDER BY line_no) AS text FROM book GROUP BY doc_id"
    return dialect.run(spark, text, documents=_documents(spark, sf_dir))


native("WIN-24 WIN-25 WIN-26", "joined_page_texts", "Books without page separators, words joined over page breaks.")(lambda spark, sf_dir: per_text(_book(spark, sf_dir), "doc_id", "text", lambda t: [(R.joined_pages(t),)], "changed string"))
native("WIN-28 WIN-29 WIN-31", "moved_footnotes", "Books with footnotes numbered anew and moved to a landing line.")(lambda spark, sf_dir: per_text(_book(spark, sf_dir), "doc_id", "text", lambda t: [(R.footnotes_moved(R.reindexed(t)),)], "changed string"))
native("JOI-26 WIN-34", "footnote_records", "Footnotes of books with label, start, end and anchor as places in the text.")(lambda spark, sf_dir: per_text(_book(spark, sf_dir), "doc_id", "text", R.footnotes, "start int, end_at int, label string, anchor int"))
