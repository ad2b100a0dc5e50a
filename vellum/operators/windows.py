"""Ordered checks over lines and paragraphs: spacing, repeats, lengths, pairs, dashes, quotes, footnotes, hyphens at line ends."""

from __future__ import annotations

from vellum.plans import base
from vellum.plans.dialect import Dialect
from vellum.plans.publish import query

SLASH = chr(92)
LONG, SHORT = 75, 55


@query("WIN-01 STR-45")
def blank_runs(d: Dialect) -> str:
    """Runs of blank lines with their length and that of the run before; odd are runs of three, of more than four, and of two behind two."""
    return base.ctes(base.book(d), f"marks AS (SELECT doc_id, line_no, {base.blank(d)} AS is_blank, sum(CASE WHEN {base.blank(d)} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM book)",
        "runs AS (SELECT doc_id, g, min(line_no) AS first_line, count(*) AS n FROM marks WHERE is_blank GROUP BY doc_id, g)") + "SELECT doc_id, first_line, n, before, n = 3 OR n > 4 OR (n = 2 AND before = 2) AS odd FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY first_line) AS before FROM runs) r"


@query("WIN-02")
def repeated_words(d: Dialect) -> str:
    """A word twice in a row on a line, or at a line's end and the next line's beginning; numbers don't count."""
    return base.ctes(base.corpus_words(d), "near AS (SELECT doc_id, line_no, token_no, word, lead(word) OVER (PARTITION BY doc_id ORDER BY line_no, token_no) AS following, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no, token_no) AS following_line FROM tokens)") + f"SELECT doc_id, line_no, word, following_line > line_no AS across FROM near WHERE word = following AND following_line - line_no <= 1 AND NOT {d.match('word', '^[0-9]+$')}"


@query("WIN-03")
def line_lengths(d: Dialect) -> str:
    """Long lines, and short lines that aren't indented, last of their paragraph, or behind a short one."""
    return base.ctes(base.book(d), f"sized AS (SELECT doc_id, line_no, line, {d.length('line')} AS size, lag({d.length('line')}) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM book WHERE NOT {d.match('line', base.NON_TEXT)})") + f"""
SELECT doc_id, line_no, size, CASE WHEN size > {LONG} THEN 'long' ELSE 'short' END AS kind FROM sized WHERE size > {LONG} OR (size BETWEEN 1 AND {SHORT - 1} AND NOT {d.match('line', '^ ')} AND following IS NOT NULL AND {d.match('following', '[^ ]')} AND coalesce(before, {SHORT}) >= {SHORT})"""


@query("WIN-04", made=True)
def hyphens_at_line_ends(d: Dialect) -> str:
    """Hyphens at line ends, dashes broken by a line end, spaced dashes."""
    return base.ctes(base.lines(d), "near AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM lines)") + f"""
SELECT doc_id, line_no, CASE WHEN {d.match('line', '-$')} AND {d.match('coalesce(following, ' + d.lit('') + ')', '^-')} THEN 'broken dash' WHEN {d.match('line', '[^-]-$')} THEN 'hyphen' ELSE 'spaced dash' END AS kind
FROM near WHERE {d.match('line', '-$| --? |--? ')}"""


def _count(d: Dialect, x: str, sign: str) -> str:
    return f"({d.length(x)} - {d.length(f'replace({x}, {d.lit(sign)}, {d.lit(chr(0) * 0)})')})"


@query("WIN-05")
def paragraph_pairs(d: Dialect) -> str:
    """Paragraphs whose quotes, underscores or brackets don't come in pairs, that begin with a small letter, or that have no end."""
    count = lambda s: _count(d, "text", s)
    pairs = " OR ".join(f"{count(a)} <> {count(b)}" for a, b in ("()", "[]", "{}"))
    return base.ctes(base.book(d), base.paragraphs(d)) + f"""
SELECT doc_id, para, start_line, {count('"')} % 2 = 1 AS odd_quotes, {count('_')} % 2 = 1 AS odd_underscores, ({pairs}) AS odd_brackets, {d.match('text', '^[a-zà-ÿ]')} AS small_start, NOT {d.match('text', '[.?!:;,”’"' + "'" + '*)' + SLASH + ']-]$')} AS no_end FROM paragraphs"""


def _pairs(d: Dialect, pattern: str, source: str, partition: str) -> str:
    """Brackets with their depth; an opening one's partner is the next closing one at its depth."""
    hits = d.all("line", pattern)
    return f"""marks AS ({d.explode('doc_id, line_no, ' + partition, hits, source, 'k', 'mark')}),
steps AS (SELECT *, CASE WHEN {d.match('mark', '^(?:</|[])}])')} THEN -1 ELSE 1 END AS step, {d.sub('mark', '[</>]') if '<' in pattern else d.translate('mark', ')]}', '([{')} AS kind FROM marks),
depths AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, {partition}, kind ORDER BY line_no, k) - CASE WHEN step = 1 THEN 1 ELSE 0 END AS depth FROM steps),
partners AS (SELECT *, lead(step) OVER (PARTITION BY doc_id, {partition}, kind, depth ORDER BY line_no, k) AS following, lag(step) OVER (PARTITION BY doc_id, {partition}, kind, depth ORDER BY line_no, k) AS before FROM depths)"""


@query("WIN-08 WIN-09 WIN-10")
def unmatched_brackets(d: Dialect) -> str:
    """Brackets without a partner in their paragraph, with nesting."""
    return base.ctes(base.book(d), base.paragraphs(d), _pairs(d, "[][(){}]".replace("[][", "[" + SLASH + "[" + SLASH + "]"), "para_marks", "para")) + "SELECT doc_id, line_no, k, mark FROM partners WHERE (step = 1 AND coalesce(following, 1) = 1) OR (step = -1 AND coalesce(before, -1) = -1)"


@query("WIN-11 WIN-12")
def unmatched_tags(d: Dialect) -> str:
    """Tags of pages without a partner, attributes and void elements left out."""
    body = f"SELECT page_id AS doc_id, 1 AS line_no, 0 AS para, {d.sub('coalesce(html, ' + d.lit('') + ')', '<(' + SLASH + 'w+) [^<>]*>', '<' + SLASH + '1>')} AS line FROM {d.table('pages')}"
    return "WITH " + f"tag_lines AS ({body}),\n" + _pairs(d, "</?(?:b|i|p|div|span|ul|li|nav|article|footer|h1|title|html|head|body)>", "tag_lines", "para") + "\nSELECT doc_id, k, mark FROM partners WHERE (step = 1 AND coalesce(following, 1) = 1) OR (step = -1 AND coalesce(before, -1) = -1)"


@query("WIN-16", made=True)
def dash_kinds(d: Dialect) -> str:
    """Dashes by kind: at a line's beginning (unless a paragraph begins), at its end, spaced, and of more than two."""
    return base.ctes(base.lines(d), f"near AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines)", f"hits AS ({d.explode('doc_id, line_no, line, before', d.all('line', ' ?(?:--+|—|–)(?: |$)?|- | -'), 'near', 'k', 'dash')})") + f"""
SELECT doc_id, line_no, k, dash, CASE WHEN {d.match('dash', '---')} THEN 'more than two' WHEN {d.match('dash', '^ .* $')} THEN 'spaced' WHEN {d.match('dash', '^ |[^ ] $')} THEN 'half spaced' WHEN before IS NOT NULL AND {d.match('line', '^(?:--|—)')} AND before <> '' THEN 'line start' ELSE 'other' END AS kind FROM hits"""


@query("WIN-17 WIN-18 HTM-67")
def bracketed_blocks(d: Dialect) -> str:
    """Bracketed notes (here: footnotes) with the line above and the next text below; odd where the line above isn't blank, or what follows begins small."""
    text = f"CASE WHEN NOT {base.blank(d)} AND NOT {d.match('line', base.NON_TEXT)} THEN line END"
    first = f"first_value({text}{' IGNORE NULLS' if d.name == 'duckdb' else ''}){'' if d.name == 'duckdb' else ' IGNORE NULLS'} OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return base.ctes(base.book(d), f"near AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS above, {first} AS below FROM book)") + f"""
SELECT doc_id, line_no, coalesce(above, '') <> '' AND NOT {d.match("coalesce(above, '')", base.NON_TEXT)} AS odd_above, coalesce({d.match('below', '^[a-zà-ÿ]')}, FALSE) AS odd_below FROM near WHERE {d.match('line', '^' + SLASH + '[Footnote [0-9]+:')}"""


@query("WIN-23")
def sequential_marks(d: Dialect) -> str:
    """The k-th mark of a text (here: the comma) replaced by its number."""
    return f"WITH parts AS ({d.explode('doc_id', d.cut('text', ','), d.table('documents'), 'k', 'part')}), joined AS (SELECT doc_id, concat(CASE WHEN k = 1 THEN '' ELSE concat('[', {d.string('k - 1')}, ']') END, part) AS part, k FROM parts) SELECT doc_id, md5({d.concat_agg('part', '', 'k')}) AS text_md5 FROM joined GROUP BY doc_id"


@query("WIN-27")
def markup_across_pages(d: Dialect) -> str:
    """Markup closed before a page break and opened behind it."""
    return base.ctes(base.book(d), "near AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS above, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS below FROM book)") + f"SELECT doc_id, line_no FROM near WHERE {d.match('line', '^-----File:')} AND {d.match('coalesce(above, ' + d.lit('') + ')', SLASH + ']$')} AND {d.match('coalesce(below, ' + d.lit('') + ')', '^' + SLASH + '[')}"


def _notes(d: Dialect) -> str:
    """Footnotes and anchors of books in their order."""
    note, anchor = "^" + SLASH + "[Footnote ([0-9]+):", "[^" + SLASH + "[]" + SLASH + "[([0-9]+)" + SLASH + "]$"
    return f"""notes AS (SELECT doc_id, line_no, CASE WHEN {d.match('line', note)} THEN 'note' ELSE 'anchor' END AS kind, CASE WHEN {d.match('line', note)} THEN {d.group('line', note, 1)} ELSE {d.group('line', anchor, 1)} END AS label, line FROM book WHERE {d.match('line', note)} OR {d.match('line', anchor)}),
paired AS (SELECT *, {d.last_seen("CASE WHEN kind = 'anchor' THEN line_no END", 'PARTITION BY doc_id, label ORDER BY line_no')} AS anchor_line FROM notes)"""


@query("JOI-26")
def footnote_anchors(d: Dialect) -> str:
    """Each footnote with the nearest anchor of its label above it: an as-of join in one window."""
    return base.ctes(base.book(d), _notes(d)) + "SELECT doc_id, line_no, label, anchor_line, anchor_line IS NULL AS unpaired FROM paired WHERE kind = 'note'"


@query("JOI-27")
def footnote_ranges(d: Dialect) -> str:
    """Each footnote with all anchors of its label between it and the footnote of that label before."""
    return base.ctes(base.book(d), _notes(d), "numbered AS (SELECT *, sum(CASE WHEN kind = 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY line_no DESC) AS behind FROM notes)") + "SELECT doc_id, label, max(CASE WHEN kind = 'note' THEN line_no END) AS note_line, CAST(sum(CASE WHEN kind = 'anchor' THEN 1 ELSE 0 END) AS BIGINT) AS anchors FROM numbered WHERE behind > 0 GROUP BY doc_id, label, behind"


@query("WIN-28 WIN-35")
def footnote_labels(d: Dialect) -> str:
    """Footnotes numbered anew through the book, with numbers, letters and Roman numerals as labels."""
    from vellum.operators.segments import roman

    letters = f"{d.repeat('substr(' + d.lit('ABCDEFGHIJKLMNOPQRSTUVWXYZ') + ', CAST((i - 1) % 26 + 1 AS INT), 1)', d.intdiv('(i - 1)', '26') + ' + 1')}"
    return base.ctes(base.book(d), _notes(d), "ranked AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM paired WHERE kind = 'note')") + f"SELECT doc_id, line_no, i, {letters} AS letter, {roman(d, 'i')} AS roman FROM ranked"


@query("WIN-29 WIN-30 WIN-31 WIN-32")
def footnote_zones(d: Dialect) -> str:
    """The place each footnote moves to: the next page break below it, or its anchor's paragraph; page breaks that get none."""
    below = f"first_value(CASE WHEN {d.match('line', '^-----File:')} THEN line_no END{' IGNORE NULLS' if d.name == 'duckdb' else ''}){'' if d.name == 'duckdb' else ' IGNORE NULLS'} OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return base.ctes(base.book(d), base.paragraphs(d), _notes(d), f"zones AS (SELECT doc_id, line_no, {below} AS zone FROM book)") + """
SELECT p.doc_id, p.line_no, z.zone, g.end_line AS paragraph_end, count(*) OVER (PARTITION BY p.doc_id, z.zone) AS in_zone FROM paired p JOIN zones z ON z.doc_id = p.doc_id AND z.line_no = p.line_no
LEFT JOIN para_marks m ON m.doc_id = p.doc_id AND m.line_no = p.anchor_line LEFT JOIN paragraphs g ON g.doc_id = m.doc_id AND g.para = m.para WHERE p.kind = 'note'"""


@query("WIN-33 WIN-34 WIN-38")
def footnote_states(d: Dialect) -> str:
    """What is to be said of each footnote: how it begins, whether it lacks an anchor or shares one, whether it is continued."""
    return base.ctes(base.book(d), _notes(d)) + f"""
SELECT doc_id, line_no, CASE WHEN {d.match('line', '^' + SLASH + '[Footnote [0-9]+: ')} THEN 'ok' WHEN {d.match('line', '^' + SLASH + '[Footnote:')} THEN 'no label' ELSE 'space' END AS start,
 CASE WHEN anchor_line IS NULL THEN 'no anchor' WHEN count(*) OVER (PARTITION BY doc_id, anchor_line) > 1 THEN 'same anchor' WHEN NOT {d.match('line', SLASH + ']$')} THEN 'continued' ELSE '' END AS state FROM paired WHERE kind = 'note'"""


@query("WIN-36 WIN-37 STR-38")
def footnotes_tidied(d: Dialect) -> str:
    """Footnotes as numbered paragraphs, and anchors masked by double braces."""
    note, anchor = "^" + SLASH + "[Footnote ([0-9]+): (.*)" + SLASH + "]$", SLASH + "[([0-9]+)" + SLASH + "]$"
    return base.ctes(base.book(d), _notes(d)) + f"SELECT doc_id, line_no, CASE WHEN kind = 'note' THEN {d.sub('line', note, '[' + SLASH + '1] ' + SLASH + '2')} ELSE {d.sub('line', anchor, '{{' + SLASH + '1}}')} END AS line FROM paired"


@query("JOI-28 STR-27 STR-35", made=True)
def dehyphenated(d: Dialect) -> str:
    """What becomes of hyphens at line ends: joined where the joined word occurs elsewhere or has a common ending, else kept; the lines with the second half moved up."""
    half, rest = d.group("line", "([" + SLASH + "p{L}]+)[-*]+$", 1), d.group("following", "^([" + SLASH + "p{L}]+)", 1)
    return base.ctes(base.corpus_words(d), f"broken AS (SELECT doc_id, line_no, line, {d.sub('line', ',$', '-')} AS cut, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM text_lines)",
        f"halves AS (SELECT doc_id, line_no, {half.replace('line', 'cut')} AS a, {rest} AS b FROM broken WHERE {d.match('cut', '[' + SLASH + 'p{L}][-*]+$')} AND {d.match('coalesce(following, ' + d.lit('') + ')', '^[' + SLASH + 'p{L}]')})") + f"""
SELECT h.doc_id, h.line_no, h.a, h.b, w.n IS NOT NULL OR {d.match('h.b', '^(?:ing|ed|ly|tion|ment|ness|able)$')} AS joined FROM halves h LEFT JOIN words w ON w.word = concat(h.a, h.b)"""  # fmt: skip


@query("STR-25 STR-26")
def line_cleanup(d: Dialect) -> str:
    """Clean-up in order, each rule on the outcome of the one before, with the number of lines that each changed."""
    rules = [("tabs", "\t", " "), ("spaced punctuation", " +([,;:?!])", SLASH + "1"), ("double spaces", "([^ ])  +", SLASH + "1 "), ("dashes", " *-- *", "--"), ("dots", "[.]{4,}", "..."), ("quotes", "''", '"'), ("end", " +$", "")]
    out, x = [f"step0 AS (SELECT doc_id, line_no, line AS x0 FROM lines)"], "x0"
    for i, (_, p, by) in enumerate(rules, 1):
        out.append(f"step{i} AS (SELECT *, {d.sub(x, p, by)} AS x{i} FROM step{i - 1})")
        x = f"x{i}"
    counts = " UNION ALL ".join(f"SELECT '{name}' AS rule, CAST(sum(CASE WHEN x{i} <> x{i - 1} THEN 1 ELSE 0 END) AS BIGINT) AS n_lines FROM step{len(rules)}" for i, (name, _, _) in enumerate(rules, 1))
    return base.ctes(base.lines(d), *out) + counts


@query("STR-30 STR-43 STR-44")
def body_lines(d: Dialect) -> str:
    """Lines between a start and an end mark (here: the second separator and the last footnote), by flags over the lines."""
    start, end = d.match("line", "^-----File:"), d.match("line", "^" + SLASH + "[Footnote")
    return base.ctes(base.book(d), f"flags AS (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS started, sum(CASE WHEN {end} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS left_over FROM book)") + "SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM flags WHERE started >= 1 AND left_over >= 1 GROUP BY doc_id"


@query("WIN-44 HTM-49 HTM-50")
def indents(d: Dialect) -> str:
    """Per paragraph the least indent and the greatest width, and the style class of each indent."""
    indent = d.length(d.group("line", "^ *", 0))
    return base.ctes(base.book(d), base.paragraphs(d)) + f"SELECT doc_id, para, min({indent}) AS least, max({d.length('line')}) AS widest, concat('.i', {d.string(f'max({indent})')}, ' {{margin-left: ', {d.string(f'max({indent}) * 5 - 30')}, '}}') AS css FROM para_marks WHERE NOT is_blank GROUP BY doc_id, para"


@query("WIN-42 STR-17 STR-18")
def aligned_lines(d: Dialect) -> str:
    """Lines up to 72 characters centred and right-aligned, and those that end in a number with the number at the margin."""
    pad = lambda n: d.repeat("' '", n)
    number = d.group("line", " ([0-9]+)$", 1)
    return base.ctes(base.lines(d)) + f"""SELECT doc_id, line_no, concat({pad(d.intdiv('(72 - ' + d.length('line') + ')', '2'))}, line) AS centred, concat({pad('72 - ' + d.length('line'))}, line) AS right_aligned,
 CASE WHEN {d.match('line', ' [0-9]+$')} THEN concat({d.sub('line', ' +[0-9]+$')}, {pad(f"greatest(2, 72 - {d.length(d.sub('line', ' +[0-9]+$'))} - {d.length(number)})")}, {number}) ELSE line END AS numbered FROM lines WHERE {d.length('line')} <= 72"""


@query("WIN-45")
def margins(d: Dialect) -> str:
    """Margins written in block markup: left, first and right, with defaults."""
    cases = d.values("m", "markup", [("/#[4.8,60]",), ("/#[4]",), ("/#",), ("/#[.6]",), ("/#[4,60]",)])
    part = lambda p, default: f"CASE WHEN {d.match('markup', p)} THEN CAST({d.group('markup', p, 1)} AS INT) ELSE {default} END"
    left = part("" + SLASH + "[([0-9]+)", 2)
    return f"SELECT markup, {left} AS left_margin, {part('[.]([0-9]+)', left)} AS first_margin, {part(',([0-9]+)', 72)} AS right_margin FROM {cases}"
