"""Lines, pages, paragraphs and what is written between them: sources' text clean-up, page marks and labels, side-cars."""

from __future__ import annotations

from vellum.plans import base
from vellum.plans.dialect import Dialect
from vellum.plans.publish import query

SLASH = chr(92)


@query("SRC-03 SRC-04 SEG-16")
def numbered_lines(d: Dialect) -> str:
    """Every line with its number from 1."""
    return base.ctes(base.lines(d)) + "SELECT doc_id, line_no, line FROM lines"


@query("SEG-01")
def non_text_lines(d: Dialect) -> str:
    """Lines of books that are separators, commands or comments."""
    return base.ctes(base.book(d)) + f"SELECT doc_id, line_no, line FROM book WHERE {d.match('line', base.NON_TEXT)}"


@query("SEG-02")
def page_of_line(d: Dialect) -> str:
    """Every line with the page it is on; lines before the first separator have none."""
    return base.ctes(base.book(d), base.pages(d)) + "SELECT doc_id, line_no, page FROM paged"


@query("SEG-03 SEG-05")
def page_flags(d: Dialect) -> str:
    """Page flags written into the text and read from it again: image, style and number of each."""
    flag = f"concat('[Img', page, '|', CASE WHEN first = 1 THEN 'Arabic' ELSE '\"' END, '|', CASE WHEN first = 1 THEN '1' ELSE '+1' END, ']', line)"
    part = lambda n: d.group("line", "^" + SLASH + "[Img([^|]*)" + SLASH + "|([^|]*)" + SLASH + "|([^" + SLASH + "]]*)" + SLASH + "]", n)
    return base.ctes(base.book(d), base.pages(d), f"flagged AS (SELECT doc_id, line_no, {flag} AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS first FROM paged WHERE own IS NOT NULL) p)") + f"SELECT doc_id, line_no, {part(1)} AS image, {part(2)} AS style, {part(3)} AS number FROM flagged"


@query("SEG-06")
def without_page_flags(d: Dialect) -> str:
    """Lines without page flags (here: without any bracketed number)."""
    return base.ctes(base.book(d)) + f"SELECT doc_id, line_no, {d.sub('line', SLASH + '[[0-9|+]+' + SLASH + ']')} AS line FROM book"


def roman(d: Dialect, n: str) -> str:
    """Small Roman numerals under 400."""
    hundreds, tens, ones = (d.array(*("'" + x + "'" for x in xs)) for xs in (["", "c", "cc", "ccc"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]))
    return f"concat({d.at(hundreds, d.intdiv(n, '100') + ' + 1')}, {d.at(tens, d.intdiv(f'({n} % 100)', '10') + ' + 1')}, {d.at(ones, f'{n} % 10 + 1')})"


def _labels(d: Dialect) -> str:
    """Page labels: the style of a page is its own or the last one's; the number starts anew where one is given, and else goes on by one, over pages that have none."""
    return f"""marks AS (SELECT doc_id, line_no, page, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM paged WHERE own IS NOT NULL),
details AS (SELECT *, CASE WHEN i = 1 THEN 'Roman' WHEN i = 4 THEN 'Arabic' END AS style, CASE WHEN i = 1 THEN 1 WHEN i = 4 THEN 1 WHEN i % 9 = 0 THEN 100 + i END AS given, i % 5 <> 0 AS counts FROM marks),
groups AS (SELECT *, {d.last_seen('style', 'PARTITION BY doc_id ORDER BY i')} AS kind, sum(CASE WHEN given IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM details),
numbers AS (SELECT *, CAST(max(given) OVER (PARTITION BY doc_id, g) + sum(CASE WHEN counts AND given IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY i) AS BIGINT) AS number FROM groups),
labels AS (SELECT doc_id, line_no, page, i, CASE WHEN NOT counts AND given IS NULL THEN '' WHEN kind = 'Roman' THEN {roman(d, 'number')} ELSE {d.string('number')} END AS label FROM numbers)"""


@query("SEG-07")
def page_labels(d: Dialect) -> str:
    return base.ctes(base.book(d), base.pages(d), _labels(d)) + "SELECT doc_id, page, i, label FROM labels"


@query("SEG-08")
def image_of_label(d: Dialect) -> str:
    """The image of the page labelled iii in each book."""
    return base.ctes(base.book(d), base.pages(d), _labels(d)) + "SELECT doc_id, page FROM labels WHERE label = 'iii'"


@query("SEG-09 SEG-10")
def paragraph_table(d: Dialect) -> str:
    """Paragraphs with their lines, length and, as an example of a place, the line that their middle falls on."""
    ends = "para_ends AS (SELECT doc_id, para, line_no, sum(CHARS + 1) OVER (PARTITION BY doc_id, para ORDER BY line_no) AS end_at FROM para_marks WHERE NOT is_blank)".replace("CHARS", d.length("line"))
    return base.ctes(base.book(d), base.paragraphs(d), ends) + f"""
SELECT p.doc_id, p.para, p.start_line, p.end_line, {d.length('p.text')} AS chars, min(e.line_no) AS middle_line
FROM paragraphs p JOIN para_ends e ON e.doc_id = p.doc_id AND e.para = p.para AND {d.intdiv(d.length('p.text'), '2')} < e.end_at GROUP BY p.doc_id, p.para, p.start_line, p.end_line, p.text"""


@query("SEG-12", made=True)
def skippable_lines(d: Dialect) -> str:
    """Lines that count as blank: block markup, thought breaks and lines of dashes (here also table rows)."""
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no FROM lines WHERE {d.match('line', '^ *(?:/[*#$CFPX]|[*#$CFPX]/|<tb>|[* ]*[*][* ]*|-+|' + SLASH + '|.*' + SLASH + '|) *$')}"


def find_all(d: Dialect, source: str, columns: str, pattern: str, x: str = "line") -> str:
    """Every match with its start and end in the line: the pieces between matches and the matches themselves give the places."""
    return f"""split_{source} AS (SELECT {columns}, {d.cut(x, pattern)} AS parts, {d.all(x, pattern)} AS hits FROM {source} WHERE {d.match(x, pattern)}),
spots AS ({d.explode(columns + ', parts, hits', 'hits', 'split_' + source, 'k', 'found')}),
found AS (SELECT {columns}, k, found, {d.total(d.each(d.slice('parts', '1', 'k'), 'x', d.length('x')))} + {d.total(d.each(d.slice('hits', '1', 'k - 1'), 'x', d.length('x')))} AS start_col FROM spots)"""


@query("SEG-13 SEG-14 SEG-15 SEG-17 RES-15 AGG-26")
def all_matches(d: Dialect) -> str:
    """All matches of a pattern with their places: digits in a row, whole."""
    return base.ctes(base.lines(d), find_all(d, "lines", "doc_id, line_no", "[0-9]+")) + f"SELECT doc_id, line_no, k, found, start_col, start_col + {d.length('found')} AS end_col FROM found"


@query("SEG-18")
def page_neighbours(d: Dialect) -> str:
    return base.ctes(base.book(d), base.pages(d)) + "SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lead(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM paged WHERE own IS NOT NULL"


@query("SNK-01 SNK-05 SNK-06 STR-56")
def saved_lines(d: Dialect) -> str:
    """Lines as they are saved: without white space at their ends, and without the blank lines just before a separator."""
    return base.ctes(base.book(d), f"bare AS (SELECT doc_id, line_no, {d.sub('line', '[ ' + SLASH + 't]+$')} AS line FROM book)", f"ahead AS (SELECT *, first_value(CASE WHEN line <> '' THEN line END{' IGNORE NULLS' if d.name == 'duckdb' else ''}){'' if d.name == 'duckdb' else ' IGNORE NULLS'} OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS coming FROM bare)") + f"SELECT doc_id, line_no, line FROM ahead WHERE line <> '' OR coming IS NULL OR NOT {d.match('coming', '^-----File:')}"


@query("SNK-03 SRC-12 SNK-02")
def side_cars(d: Dialect) -> str:
    """What the side-car of a document says: checksum, language, its pages by image with style and number."""
    entry = "concat('\"', page, '\":{\"index\":\"', line_no, '\",\"number\":\"', CASE WHEN i = 1 THEN '1' ELSE '+1' END, '\"}')"
    entry = entry.replace(" line_no,", f" {d.string('line_no')},")
    return base.ctes(base.book(d), base.pages(d), "marks AS (SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM paged WHERE own IS NOT NULL)", f"details AS (SELECT doc_id, concat('{{', {d.concat_agg(entry, ',', 'line_no')}, '}}') AS pagedetails FROM marks GROUP BY doc_id)") + f"SELECT t.doc_id, md5(t.text) AS md5checksum, t.lang AS languages, p.pagedetails FROM {d.table('documents')} t LEFT JOIN details p ON p.doc_id = t.doc_id"


@query("SNK-04 SRC-05")
def page_texts(d: Dialect) -> str:
    """The text of each page without its separator and without blank lines at its end: one file each."""
    return base.ctes(base.book(d), base.pages(d), "kept AS (SELECT * FROM paged WHERE page IS NOT NULL AND own IS NULL)", f"joined AS (SELECT doc_id, page, {d.concat_agg('line', chr(10), 'line_no') if d.name == 'duckdb' else 'listagg(line, char(10)) WITHIN GROUP (ORDER BY line_no)'} AS text FROM kept GROUP BY doc_id, page)") + f"SELECT doc_id, page, {d.sub('text', SLASH + 's+$')} AS text FROM joined"


@query("SNK-09")
def page_names(d: Dialect) -> str:
    """Names of pages: of each section's prefix, numbers and suffixes, with zeros to three digits."""
    sections = d.values("s", "prefix, a, b, suffixes", [("p", 1, 12, ",a"), ("plate", 1, 3, ""), ("a", 98, 104, "")])
    return f"WITH numbers AS ({d.explode('prefix, suffixes', d.seq('a', 'b'), sections, 'k', 'n')}), suffixed AS ({d.explode('prefix, n', d.cut('suffixes', ','), 'numbers', 'k', 'suffix')}) SELECT concat(prefix, lpad({d.string('n')}, 3, '0'), suffix, '.png') AS page FROM suffixed"


@query("SNK-10")
def renumbered_pages(d: Dialect) -> str:
    """Separators with their new images: the k-th separator of a book gets the k-th name."""
    return base.ctes(base.book(d), base.pages(d)) + f"SELECT doc_id, line_no, replace(line, own, lpad({d.string('row_number() OVER (PARTITION BY doc_id ORDER BY line_no)')}, 4, '0')) AS line FROM paged WHERE own IS NOT NULL"


@query("SNK-12")
def included_text(d: Dialect) -> str:
    """Each document with the first benchmark item put behind its first line."""
    at = f"CASE WHEN {d.position('t.text', d.char(10))} = 0 THEN {d.length('t.text')} ELSE {d.position('t.text', d.char(10))} END"
    return f"SELECT t.doc_id, concat(substr(t.text, 1, CAST({at} AS INT)), b.text, substr(t.text, CAST({at} + 1 AS INT))) AS text FROM {d.table('documents')} t, (SELECT text FROM {d.table('benchmark')} ORDER BY item_id LIMIT 1) b"


@query("WIN-19")
def page_heads_and_feet(d: Dialect) -> str:
    """First and last line of each page that isn't blank."""
    return base.ctes(base.book(d), base.pages(d), f"ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS first, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS last FROM paged WHERE own IS NULL AND page IS NOT NULL AND NOT {base.blank(d)})") + "SELECT doc_id, page, CASE WHEN first = 1 THEN 'head' ELSE 'foot' END AS place, line_no, line FROM ranked WHERE first = 1 OR last = 1"


@query("WIN-20")
def head_kinds(d: Dialect) -> str:
    """Kinds of head lines: page number, number with capitals, capitals, by odd and even pages; a lone year is none."""
    kind = f"CASE WHEN {d.match('line', '^ *1[5-9][0-9][0-9][.]? *$')} THEN 'year' WHEN {d.match('line', '^ *[0-9]+ *$')} THEN 'page number' WHEN {d.match('line', '^ *[0-9]+ +[A-Z ]+$|^[A-Z ]+ +[0-9]+ *$')} THEN 'number and capitals' WHEN line = {d.upper('line')} AND {d.match('line', '[A-Z]')} THEN 'capitals' ELSE 'text' END"
    return base.ctes(base.book(d), base.pages(d), f"ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS first FROM paged WHERE own IS NULL AND page IS NOT NULL AND NOT {base.blank(d)})") + f"SELECT doc_id, page, CAST(page AS INT) % 2 = 1 AS odd, {kind} AS kind FROM ranked WHERE first = 1"


@query("WIN-21")
def empty_pages(d: Dialect) -> str:
    """Pages of white space get a placeholder; all pages with their new text."""
    return base.ctes(base.book(d), base.pages(d), f"sums AS (SELECT doc_id, page, max(CASE WHEN {base.blank(d)} OR own IS NOT NULL THEN 0 ELSE 1 END) AS filled FROM paged WHERE page IS NOT NULL GROUP BY doc_id, page)") + "SELECT doc_id, page, CASE WHEN filled = 0 THEN '[Blank Page]' ELSE 'text' END AS content FROM sums"


@query("WIN-22")
def page_order(d: Dialect) -> str:
    """Pages whose name comes before that of the page above them."""
    return base.ctes(base.book(d), base.pages(d), "ordered AS (SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY line_no) AS above FROM paged WHERE own IS NOT NULL)") + "SELECT doc_id, page, above FROM ordered WHERE page < above"


@query("WIN-24 WIN-25 WIN-26 STR-31")
def page_joins(d: Dialect) -> str:
    """What joining pages does at each separator, by the blank lines behind it and the ends of the text beside it: keep a break, join a word, join lines."""
    return base.ctes(base.book(d), f"seen AS (SELECT *, {d.last_seen(f'CASE WHEN NOT {base.blank(d)} AND NOT ' + d.match('line', base.NON_TEXT) + ' THEN line END', 'PARTITION BY doc_id ORDER BY line_no')} AS above, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS l1, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS l2, lead(line, 3) OVER (PARTITION BY doc_id ORDER BY line_no) AS l3 FROM book)") + f"""
SELECT doc_id, line_no, CASE WHEN l1 = '' AND l2 = '' THEN 'chapter' WHEN l1 = '' THEN 'paragraph' WHEN {d.match('above', '[^-]-[*]?$')} THEN 'word' WHEN {d.match('above', '(?:--|—)[*]?$')} THEN 'dash' ELSE 'line' END AS action FROM seen WHERE {d.match('line', '^-----File:')} AND above IS NOT NULL"""
