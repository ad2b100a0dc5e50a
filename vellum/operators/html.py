"""Pages of HTML as tables: tags with their places, links, ids, classes, headings, images; checks and conversions of pages and of text into pages."""

from __future__ import annotations

from vellum.operators.words import fold
from vellum.plans.dialect import Dialect
from vellum.plans.publish import query

SLASH = chr(92)
HTML = "coalesce(html, '')"


def tags(d: Dialect) -> str:
    """page_id, ord, tag, attributes of each opening tag; scripts, styles and comments are left out."""
    body = d.sub(HTML, "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>")
    return f"raw_tags AS ({d.explode('page_id', d.all(body, '<[a-zA-Z][a-zA-Z0-9]*[^<>]*>'), d.table('pages'), 'ord', 'raw')}),\ntags AS (SELECT page_id, ord, lower({d.group('raw', '^<([a-zA-Z0-9]+)', 1)}) AS tag, raw FROM raw_tags)"


def attribute(d: Dialect, name: str) -> str:
    return d.group("raw", f" {name}=[\"']([^\"']*)[\"']", 1)


def links(d: Dialect) -> str:
    return f"links AS (SELECT page_id, ord, {attribute(d, 'href')} AS href FROM tags WHERE {d.match('raw', ' href=')})"


@query("HTM-13 SEG-03")
def tag_table(d: Dialect) -> str:
    """Every opening tag with its order, links and classes."""
    return f"WITH {tags(d)} SELECT page_id, ord, tag, {attribute(d, 'href')} AS href, {attribute(d, 'class')} AS class FROM tags"


@query("HTM-15 JOI-22")
def link_inventory(d: Dialect) -> str:
    """Links by kind with their count per page: empty, external, to a place in the page, with capitals, to another page."""
    kind = f"CASE WHEN href = '' THEN 'empty' WHEN {d.match('href', '^(?:https?:)?//')} THEN 'external' WHEN {d.match('href', '^#')} THEN 'place' WHEN {d.match('href', '[A-Z]')} THEN 'capitals' ELSE 'page' END"
    return f"WITH {tags(d)}, {links(d)} SELECT page_id, {kind} AS kind, count(*) AS n, count(DISTINCT href) AS different FROM links GROUP BY page_id, {kind}"


@query("JOI-20 JOI-23 JOI-24")
def unresolved_links(d: Dialect) -> str:
    """Links whose target no page's address ends in, and addresses that no link leads to: anti-joins both ways."""
    target = d.group("href", "/([^/?#]+)[^/]*$", 1)
    own = d.group("url", "/([^/?#]+)[^/]*$", 1)
    return f"""WITH {tags(d)}, {links(d)}, targets AS (SELECT DISTINCT {target} AS name FROM links WHERE {target} <> ''), names AS (SELECT DISTINCT {own} AS name FROM {d.table('pages')} WHERE {own} <> '')
SELECT 'missing' AS problem, t.name FROM targets t LEFT JOIN names n ON n.name = t.name WHERE n.name IS NULL UNION ALL SELECT 'unused' AS problem, n.name FROM names n LEFT JOIN targets t ON t.name = n.name WHERE t.name IS NULL"""


@query("HTM-11")
def external_links(d: Dialect) -> str:
    """Addresses of other hosts in pages, five at most per page, with the host."""
    found = d.all(HTML, "https?://[^\"'<> ]+")
    return f"WITH hits AS ({d.explode('page_id', found, d.table('pages'), 'k', 'address')}) SELECT page_id, k, {d.group('address', '^https?://([^/?#]+)', 1)} AS host FROM hits WHERE k <= 5"


@query("HTM-14")
def duplicate_targets(d: Dialect) -> str:
    """Values of an attribute that a page has more than once (here: link targets)."""
    return f"WITH {tags(d)}, {links(d)} SELECT page_id, href, count(*) AS n FROM links GROUP BY page_id, href HAVING count(*) > 1"


@query("HTM-16 HTM-32")
def titles(d: Dialect) -> str:
    """Titles and first headings: one of each, the same words; and the title as a file name."""
    title, h1 = d.all(HTML, "<title>([^<]*)</title>", 1), d.all(HTML, "<h1>([^<]*)</h1>", 1)
    name = d.sub(fold(d, d.group(HTML, "<title>([^<]*)</title>", 1)), "[^0-9A-Za-z]+", "-")
    return f"SELECT page_id, {d.size(title)} AS n_titles, {d.size(h1)} AS n_h1, {d.at(title, '1')} = {d.at(h1, '1')} AS same, {name} AS file_name FROM {d.table('pages')}"


@query("HTM-17 HTM-18 HTM-19 HTM-20 HTM-01")
def page_checks(d: Dialect) -> str:
    """Checks of whole pages: doctype, character set, language, preformatted text."""
    return f"SELECT page_id, {d.match(HTML, '(?i)^<!doctype html>')} AS doctype, {d.match(HTML, '(?i)charset=.?utf-8')} AS utf8, {d.group(HTML, '<html[^<>]* lang=.([a-z]+)', 1)} AS language, {d.size(d.all(HTML, '<pre[ >]'))} AS n_pre FROM {d.table('pages')}"


@query("HTM-21")
def image_texts(d: Dialect) -> str:
    """Tags without text of their own (here: breaks and metas) by kind and page, as images are by their texts."""
    return f"WITH {tags(d)} SELECT page_id, tag, count(*) AS n, CAST(sum(CASE WHEN {d.match('raw', ' alt=')} THEN 1 ELSE 0 END) AS BIGINT) AS with_text FROM tags WHERE tag IN ('img', 'br', 'meta', 'hr', 'link') GROUP BY page_id, tag"


@query("HTM-22")
def heading_outline(d: Dialect) -> str:
    """Headings in order, indented by level."""
    found = d.all(HTML, "<h[1-6][^<>]*>[^<]*")
    level = f"CAST({d.group('heading', '^<h([1-6])', 1)} AS INT)"
    return f"WITH heads AS ({d.explode('page_id', found, d.table('pages'), 'k', 'heading')}) SELECT page_id, k, concat({d.repeat(d.lit('  '), level + ' - 1')}, {d.sub('heading', '^<[^<>]*>')}) AS line FROM heads"


@query("HTM-23 AGG-25")
def element_counts(d: Dialect) -> str:
    return f"WITH {tags(d)} SELECT page_id, CAST(sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) AS BIGINT) AS n_h2, CAST(sum(CASE WHEN tag = 'h1' THEN 1 ELSE 0 END) AS BIGINT) AS n_h1, CAST(sum(CASE WHEN tag = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS n_tables, CAST(sum(CASE WHEN {d.match('raw', ' class=.ad')} THEN 1 ELSE 0 END) AS BIGINT) AS n_ads FROM tags GROUP BY page_id"


@query("HTM-24 HTM-25 JOI-21")
def classes(d: Dialect) -> str:
    """Classes and elements that are used or have a style, over all pages: used without a style, with a style but not used."""
    style = d.all(d.group(HTML, "(?s)<style>(.*?)</style>", 1), "([a-z][a-z0-9]*)" + SLASH + "{", 1)
    used = f"SELECT {attribute(d, 'class')} AS name, count(*) AS n FROM tags WHERE {d.match('raw', ' class=')} GROUP BY {attribute(d, 'class')} UNION ALL SELECT tag, count(*) FROM tags WHERE tag IN ('p', 'b') GROUP BY tag"
    return f"WITH {tags(d)}, styled AS ({d.explode('page_id', style, d.table('pages'), 'k', 'name')}), defined AS (SELECT DISTINCT name FROM styled), used AS ({used}) SELECT coalesce(u.name, s.name) AS name, coalesce(u.n, 0) AS n_used, s.name IS NOT NULL AS defined FROM used u FULL OUTER JOIN defined s ON s.name = u.name"


@query("HTM-33")
def id_ranks(d: Dialect) -> str:
    """Link names ranked by likeness to a word: equal first, then those that begin with it, then those that hold it."""
    return f"WITH {tags(d)}, {links(d)}, names AS (SELECT {d.sub('href', '^/')} AS name, count(*) AS n FROM links GROUP BY {d.sub('href', '^/')}) SELECT name, n, CASE WHEN name = 'the' THEN 1 WHEN {d.match('name', '^the')} THEN 2 ELSE 3 END AS kind FROM names WHERE {d.position('name', d.lit('the'))} > 0"


@query("HTM-58 HTM-57")
def tidy_pages(d: Dialect) -> str:
    """Pages without empty paragraphs and with single blank lines, line ends behind closed paragraphs."""
    return f"SELECT page_id, md5({d.sub(d.sub(d.sub(HTML, '<p>[ ]*</p>'), '</p>', '</p>' + chr(10)), chr(10) + '{3,}', chr(10) * 2)}) AS html_md5 FROM {d.table('pages')}"


@query("HTM-63 HTM-61")
def page_texts_plain(d: Dialect) -> str:
    """The text of a page for comparison: without head, navigation, notes and tags, spaces single."""
    body = d.sub(HTML, "(?s)<head>.*?</head>|<nav>.*?</nav>|<!--.*?-->|<footer>.*?</footer>")
    text = d.sub(d.sub(body, "<[^<>]*>", " "), "[ \t\n]+", " ")
    return f"SELECT page_id, md5(trim({text})) AS text_md5, {d.length(f'trim({text})')} AS n_chars FROM {d.table('pages')}"


@query("HTM-34 HTM-35 ARR-05")
def table_rows(d: Dialect) -> str:
    """Lines that are rows of a table as HTML rows, a cell for each part between bars."""
    from vellum.plans import base

    cells = d.each(d.cut(d.sub(d.sub("line", "^ *" + SLASH + "| *"), " *" + SLASH + "| *$"), " *" + SLASH + "| *"), "c", "concat('<td>', c, '</td>')")
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, concat('<tr>', {d.join(cells, '')}, '</tr>') AS html FROM lines WHERE {d.match('line', ' ' + SLASH + '| [^|]* ' + SLASH + '| ')}"


@query("HTM-36")
def list_items(d: Dialect) -> str:
    """Paragraphs as items of a list."""
    from vellum.plans import base

    return base.ctes(base.book(d), base.paragraphs(d)) + f"SELECT doc_id, para, concat('<li>', {d.sub('text', '^[-*0-9.]+ +')}, '</li>') AS html FROM paragraphs"


@query("HTM-30 HTM-31")
def log_messages(d: Dialect) -> str:
    """Lines of a converter's log as severity and message, by severity and then in their order (here: events as lines)."""
    line = f"concat(CASE WHEN value > 80 THEN 'ERROR' WHEN value > 60 THEN 'WARNING' ELSE 'INFO' END, ':', event_type, ':', {d.string('user_id')})"
    return f"""WITH log AS (SELECT event_id, {line} AS line FROM {d.table('events')}), parts AS (SELECT event_id, {d.group('line', '^([A-Z]+):(.*)$', 1)} AS severity, {d.group('line', '^([A-Z]+):(.*)$', 2)} AS message FROM log)
SELECT event_id, severity, message, CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS kind FROM parts WHERE severity <> 'INFO'"""


@query("HTM-26")
def page_leftovers(d: Dialect) -> str:
    """Leftovers of markup in pages' text: double signs, unconverted italics, straight dashes."""
    text = d.sub(d.sub(HTML, "(?s)<head>.*?</head>"), "<[^<>]*>", " ")
    rules = [("ampersands", "&amp;&amp;"), ("double hyphen", "--"), ("brackets", SLASH + "[[a-z]+" + SLASH + "]"), ("stars", "[*]{3}")]
    return f"WITH texts AS (SELECT page_id, {text} AS body FROM {d.table('pages')}) " + " UNION ALL ".join(f"SELECT page_id, '{name}' AS problem, {d.size(d.all('body', p))} AS n FROM texts WHERE {d.match('body', p)}" for name, p in rules)


@query("HTM-59 HTM-56")
def wrapped_pages(d: Dialect) -> str:
    """Paragraphs of books put between a header and a footer, with chapters where a paragraph follows a page break."""
    from vellum.plans import base

    made = f"concat('<p>', {d.sub(d.sub('text', '&', '&amp;'), '<', '&lt;')}, '</p>')"
    joined = d.concat_agg(made, "", "para")
    return base.ctes(base.book(d), base.paragraphs(d)) + f"SELECT doc_id, md5(concat('<!DOCTYPE html><html><body>', {joined}, '</body></html>')) AS html_md5, count(*) AS n FROM paragraphs GROUP BY doc_id"


@query("HTM-03")
def file_sizes(d: Dialect) -> str:
    """Sizes of files (here: pages) with a verdict, the largest first within their site."""
    size = d.length(HTML)
    return f"SELECT page_id, {size} AS size, CASE WHEN {size} > 20000 THEN 'error' WHEN {size} > 5000 THEN 'warning' ELSE 'pass' END AS verdict, row_number() OVER (PARTITION BY {d.group('url', '^https?://([^/]+)', 1)} ORDER BY {size} DESC, page_id) AS place FROM {d.table('pages')}"


@query("HTM-38")
def tex_separators(d: Dialect) -> str:
    """Separators of pages in three forms read as one: number and style."""
    forms = d.values("s", "line", [("%% -----File: 001.png---",), (SLASH + "PageSep{12}{x}{012.png}",), (SLASH + "newpage % 7",), ("text",)])
    image = f"coalesce(nullif({d.group('line', '-----File: ?([0-9a-z]+)', 1)}, ''), nullif({d.group('line', '([0-9]+)[.]png', 1)}, ''), nullif({d.group('line', 'newpage % ([0-9]+)', 1)}, ''))"
    return f"SELECT line, {image} AS image, {d.match('line', '[{][ivxlc]+[}]')} AS is_roman FROM {forms}"


def _grid(d: Dialect) -> str:
    """Tables of documents: lines with bars, cut into cells."""
    from vellum.plans import base

    cells = d.each(d.cut(d.sub(d.sub("line", "^ *" + SLASH + "|"), SLASH + "| *$"), SLASH + "|"), "c", "trim(c)")
    return base.ctes(base.lines(d), f"grid AS (SELECT doc_id, line_no, {cells} AS cells FROM lines WHERE {d.match('line', ' ' + SLASH + '| [^|]* ' + SLASH + '| ')})")


@query("ARR-01 ARR-02 ARR-03 ARR-20")
def column_widths(d: Dialect) -> str:
    """The widest cell of each column of each document's table."""
    return _grid(d) + f", cells AS ({d.explode('doc_id, line_no', 'cells', 'grid', 'col', 'cell')}) SELECT doc_id, col, max({d.length('cell')}) AS width FROM cells GROUP BY doc_id, col"


@query("ARR-06 ARR-12 ARR-08 ARR-04")
def padded_grid(d: Dialect) -> str:
    """Rows with all cells padded to their column's width and bars between."""
    return _grid(d) + f""", cells AS ({d.explode('doc_id, line_no', 'cells', 'grid', 'col', 'cell')}), widths AS (SELECT doc_id, col, max({d.length('cell')}) AS width FROM cells GROUP BY doc_id, col),
padded AS (SELECT c.doc_id, c.line_no, c.col, concat(c.cell, {d.repeat("' '", 'w.width - ' + d.length('c.cell'))}) AS cell FROM cells c JOIN widths w ON w.doc_id = c.doc_id AND w.col = c.col)
SELECT doc_id, line_no, concat('|', {d.concat_agg('cell', '|', 'col')}, '|') AS line FROM padded GROUP BY doc_id, line_no"""


@query("ARR-14")
def cells_to_rows(d: Dialect) -> str:
    """Paragraphs of one cell per line as rows of a grid."""
    from vellum.plans import base

    return base.ctes(base.book(d), base.paragraphs(d)) + f"SELECT doc_id, para, {d.concat_agg('line', '|', 'line_no')} AS row FROM para_marks WHERE NOT is_blank GROUP BY doc_id, para"


@query("ARR-15")
def spaced_tables(d: Dialect) -> str:
    """Rows of tables with an empty row behind each that keeps the bars."""
    return _grid(d) + f", both_rows AS ({d.explode('doc_id, line_no', d.array(d.join('cells', '|'), d.join(d.each('cells', 'c', d.lit('')), '|')), 'grid', 'k', 'row')}) SELECT doc_id, line_no, k, row FROM both_rows"


@query("ARR-18 ARR-19")
def vertical_lines(d: Dialect) -> str:
    """A bar put in at a column of each line, over a space or between characters, and what stands when it is taken out."""
    from vellum.plans import base

    put = "concat(substr(line, 1, 10), '|', substr(line, CASE WHEN substr(line, 11, 1) = ' ' THEN 12 ELSE 11 END))"
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {put} AS changed, concat(substr({put}, 1, 10), substr({put}, 12)) AS back FROM lines WHERE {d.length('line')} > 12"
