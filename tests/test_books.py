"""Operators over texts that have page separators, footnotes, blank lines and block markup of their own, against rows written by hand."""

import pytest

from vellum.operators import marks, segments, windows, words
from vellum.plans import dialect

BOOK = """before any page
-----File: 005.png---user-----
First line of the text,
second line (not closed.

-----File: 006.png---user-----
A third[1] line.
[Footnote 1: what it says]


Last line
the the end"""


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(1, BOOK, "en", "s"), (2, None, None, None), (3, "no pages", "en", "s")], "doc_id long, text string, lang string, source string")


def rows(spark, books, text, *columns):
    return sorted((tuple(r[c] for c in columns) for r in dialect.run(spark, text, documents=books).collect()), key=repr)


def test_pages(spark, books):
    page = dict(rows(spark, books.filter("doc_id = 1"), segments.page_of_line, "line_no", "page"))
    assert [page[i] for i in range(1, 13)] == [None] + ["005"] * 4 + ["006"] * 7
    assert rows(spark, books, segments.page_texts, "doc_id", "page", "text") == [(1, "005", "First line of the text,\nsecond line (not closed."), (1, "006", "A third[1] line.\n[Footnote 1: what it says]\n\n\nLast line\nthe the end")]
    assert rows(spark, books, segments.page_neighbours, "page", "before", "after") == [("005", None, "006"), ("006", "005", None)]
    assert (1, 2, "-----File: 005.png---user-----") in rows(spark, books, segments.non_text_lines, "doc_id", "line_no", "line")
    assert [(n, line) for d, n, line in rows(spark, books, segments.renumbered_pages, "doc_id", "line_no", "line") if d == 1] == [(2, "-----File: 0001.png---user-----"), (6, "-----File: 0002.png---user-----")]


def test_paragraphs_and_pairs(spark, books):
    got = rows(spark, books.filter("doc_id = 1"), segments.paragraph_table, "start_line", "end_line", "chars")
    assert got == [(1, 4, 64), (11, 12, 21), (7, 8, 43)]
    assert rows(spark, books, windows.unmatched_brackets, "doc_id", "line_no", "mark") == [(1, 4, "(")]
    assert rows(spark, books, windows.blank_runs, "first_line", "n") == [(1, 1), (5, 1), (9, 2)]
    assert (1, 12, "the") in rows(spark, books, windows.repeated_words, "doc_id", "line_no", "word")


def test_footnotes(spark, books):
    """No anchor ends a line here, so the note has none; one at a line's end is found."""
    assert rows(spark, books, windows.footnote_anchors, "line_no", "label", "anchor_line") == [(8, "1", None)]
    one = spark.createDataFrame([(1, "a word[2]\n\n[Footnote 2: x]\nb[2]\n[Footnote 2: y]", "en", "s")], "doc_id long, text string, lang string, source string")
    assert rows(spark, one, windows.footnote_anchors, "line_no", "anchor_line", "unpaired") == [(3, 1, False), (5, 4, False)]


def test_words_of_given_texts(spark, books):
    counted = dict(rows(spark, books, words.word_counts, "word", "n"))
    assert counted["line"] == 4 and counted["the"] == 3 and "png" not in counted


def test_block_markup(spark):
    text = "/#\na\n/#\nb\n#/\n#/\n/*\nx\n/P\ny\nP/\nC/\n/#[4.6,60]\n/$\nz\n$/\n/q"
    one = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert rows(spark, one, marks.block_markup, "line_no", "problem") == [(12, "not opened"), (13, "not closed"), (17, "malformed"), (7, "not closed")]


def test_shifted_lines(spark):
    one = spark.createDataFrame([(1, "  a\n      b\n\n c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert rows(spark, one, marks.shifted_lines, "line_no", "more", "less", "block_less") == [(1, "      a", "a", "a"), (2, "          b", "  b", "    b"), (4, "     c", "c", "c")]
