"""Common first steps of relational queries: lines, the book fixture, tokens, paragraphs, pages."""

from __future__ import annotations

from vellum.plans.dialect import Dialect

#: Separator of the pages of a book, and what non-text lines look like (SEG-01): separators, dot commands, comments.
SEPARATOR = r"^-----File: ?[^-]*?\.(?:png|jpg)-*"
NON_TEXT = r"^(?:-----File:|\.[a-z]{2}[ ]|//)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def lines(d: Dialect) -> str:
    """doc_id, line_no (from 1), line."""
    return f"lines AS ({d.explode('doc_id', d.cut('coalesce(text, ' + d.lit('') + ')', chr(10)), d.table('documents'), 'line_no', 'line')})"


def book(d: Dialect) -> str:
    """lines, and the same as book: the lines of documents that have page separators, blank lines, footnotes and block markup."""
    return f"{lines(d)},\nbook AS (SELECT doc_id, line_no, line FROM lines)"


def book_fixture(d: Dialect) -> str:
    """Documents made into books for the registered queries, as the driver's tables have none. By place, lines become blank, end in a footnote's anchor, become a footnote, are indented, or become a page separator; some also get what checks are about:
    block markup, brackets, dashes, hyphens, ligatures, fractions, odd signs. Within the row; operators take any documents."""
    n = "CAST(i AS BIGINT)" if d.name == "duckdb" else "(CAST(i AS BIGINT) + 1)"
    page = f"CASE WHEN doc_id % 4 = 3 THEN 500 - {d.intdiv(n, '8')} ELSE {d.intdiv(n, '8')} + doc_id % 100 END"
    label = d.string(f"{n} % 3 + 1")
    line = f"""CASE
  WHEN {n} % 8 = 1 THEN concat('-----File: ', lpad({d.string(page)}, 3, '0'), '.png---user-----')
  WHEN {n} % 7 = 0 OR {n} % 21 = 8 THEN ''
  WHEN {n} % 11 = 3 THEN concat(x, '[', {label}, ']')
  WHEN {n} % 11 = 6 THEN concat('[Footnote ', {label}, ': ', x, ']')
  WHEN {n} % 13 = 4 THEN concat('  ', x)
  WHEN doc_id % 4 = 1 AND {n} = 2 THEN concat('/', '*')
  WHEN doc_id % 4 = 1 AND {n} = 10 AND doc_id % 8 = 1 THEN concat('*', '/')
  WHEN doc_id % 4 = 1 AND {n} % 5 = 0 THEN concat('<i>', x, '</i>')
  WHEN doc_id % 4 = 2 AND {n} % 5 = 0 THEN concat(x, ' (and so')
  WHEN doc_id % 4 = 2 AND {n} % 5 = 2 THEN concat('--', x, ' word--and - more --- and Mrs.--who -- ', '<', 'i>open')
  WHEN doc_id % 4 = 3 AND {n} % 5 = 0 THEN concat(x, ' com-')
  WHEN doc_id % 4 = 3 AND {n} % 5 = 1 THEN concat('mon common ', x)
  WHEN doc_id % 4 = 0 AND {n} % 5 = 0 THEN concat(x, ' Cæsar Caesar C[oe]ur œuvre wоrd 1/2 3-1/4 to-day today to--day thIs {{x}} ~ |')
  WHEN doc_id % 4 = 0 AND {n} = 2 THEN '<tb>'
  WHEN doc_id % 4 = 0 AND {n} = 12 THEN concat('.bn ', lpad({d.string(page)}, 3, '0'), '.png')
  ELSE x END"""
    parts = d.cut("coalesce(text, " + d.lit("") + ")", chr(10))
    made = f"list_transform({parts}, lambda x, i: {line})" if d.name == "duckdb" else f"transform({parts}, (x, i) -> {line})"
    return f"SELECT doc_id, {d.join(made, chr(10)) if d.name == 'duckdb' else f'array_join({made}, char(10))'} AS text, lang, source FROM {d.table('documents')}"


def text_lines(d: Dialect, source: str = "lines") -> str:
    """Lines that are text."""
    return f"text_lines AS (SELECT * FROM {source} WHERE NOT {d.match('line', NON_TEXT)})"


def cleaned(d: Dialect, x: str) -> str:
    """A line as the word counter sees it: without tags, and only letters, marks, digits and the signs that stand in words."""
    return d.sub(d.sub(x, "</?[a-z]*>", " "), "[^\\p{L}\\p{M}\\p{N}'’.,*_\\-—]+", " ")


def tokens(d: Dialect, source: str = "text_lines") -> str:
    """doc_id, line_no, word: tokens with punctuation at their ends removed; parts beside a long dash are words of their own."""
    parts = d.cut(cleaned(d, "line"), " |--+|—")
    bare = d.sub("token", "^[^\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]+$", "")
    return f"""raw_tokens AS ({d.explode('doc_id, line_no', parts, source, 'token_no', 'token')}),
tokens AS (SELECT * FROM (SELECT doc_id, line_no, token_no, {bare} AS word FROM raw_tokens) w WHERE word <> '' AND NOT {d.match('word', '(?i)[.](?:png|jpg)$')})"""


def words(d: Dialect) -> str:
    """word, n over all documents."""
    return "words AS (SELECT word, count(*) AS n FROM tokens GROUP BY word)"


def words_and_docs(d: Dialect) -> str:
    """word, n, and docs: how many documents have it. Counted by document first, which needs no second look at the texts. The filter, always true, has every use of it ask for the same columns, so that Spark computes it once."""
    return "words AS (SELECT * FROM (SELECT word, CAST(sum(c) AS BIGINT) AS n, count(*) AS docs FROM (SELECT doc_id, word, count(*) AS c FROM tokens GROUP BY doc_id, word) g GROUP BY word) w WHERE n > 0 AND docs > 0)"


def corpus_words(d: Dialect, docs: bool = False) -> str:
    return f"{lines(d)},\n{text_lines(d)},\n{tokens(d)},\n{words_and_docs(d) if docs else words(d)}"


def blank(d: Dialect, x: str = "line") -> str:
    return d.match(x, "^ *$")


def paragraphs(d: Dialect, source: str = "book") -> str:
    """doc_id, para_no, start_line, end_line, text (lines joined by spaces): runs of lines that aren't blank."""
    return f"""para_marks AS (SELECT doc_id, line_no, line, {blank(d)} AS is_blank, sum(CASE WHEN {blank(d)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM {source} WHERE NOT {d.match('line', NON_TEXT)}),
paragraphs AS (SELECT doc_id, para, min(line_no) AS start_line, max(line_no) AS end_line, {d.concat_agg('line', ' ', 'line_no')} AS text FROM para_marks WHERE NOT is_blank GROUP BY doc_id, para)"""


def pages(d: Dialect) -> str:
    """paged: the book's lines with the page each is on."""
    image = f"CASE WHEN {d.match('line', '^-----File:')} THEN {d.group('line', '^-----File: *([^-.]+)', 1)} END"
    return f"paged AS (SELECT doc_id, line_no, line, image AS own, {d.last_seen('image', 'PARTITION BY doc_id ORDER BY line_no')} AS page FROM (SELECT doc_id, line_no, line, {image} AS image FROM book) b)"
