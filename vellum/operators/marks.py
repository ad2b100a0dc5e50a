"""Marks of lines and pages: block markup, page commands, shifts of lines, values of style attributes, tables without blank rows."""

from __future__ import annotations

from vellum.plans import base
from vellum.plans.dialect import Dialect
from vellum.plans.publish import query

#: Kinds of block markup; only the first nests.
BLOCKS = "#$*PLFXICR"
SLASH = chr(92)


@query("WIN-13", made=True)
def block_markup(d: Dialect) -> str:
    """Openings and closings of block markup that don't match: a kind that doesn't nest must be closed before any other mark; # by depth. Also lines that look like block markup and aren't."""
    signs = BLOCKS.replace("#", "").replace("$", "[$]").replace("*", "[*]")
    kind = "|".join(["#", *("[$]", "[*]"), *signs.replace("[$]", "").replace("[*]", "")])
    opening, closing = f"(?i)^/({kind})(?:{SLASH}[[0-9.,]*{SLASH}])?$", f"(?i)^({kind})/$"
    step = f"CASE WHEN {d.match('line', opening)} THEN 1 WHEN {d.match('line', closing)} THEN -1 WHEN {d.match('line', '^/[^/ ]?$|^[^/ ]/$|^/[#$*]')} THEN 0 END"
    name = f"upper(CASE WHEN {d.match('line', opening)} THEN {d.group('line', opening, 1)} ELSE {d.group('line', closing, 1)} END)"
    by = "PARTITION BY doc_id ORDER BY line_no"
    return base.ctes(
        base.lines(d),
        f"marks AS (SELECT doc_id, line_no, line, {step} AS step, {name} AS kind FROM lines WHERE {step} IS NOT NULL)",
        f"near AS (SELECT *, lead(step) OVER ({by}) AS next_step, lead(kind) OVER ({by}) AS next_kind, lag(step) OVER ({by}) AS last_step, lag(kind) OVER ({by}) AS last_kind FROM marks WHERE step <> 0)",
        "depths AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, kind ORDER BY line_no) - CASE WHEN step = 1 THEN 1 ELSE 0 END AS depth FROM near)",
        "pairs AS (SELECT *, lead(step) OVER (PARTITION BY doc_id, kind, depth ORDER BY line_no) AS below, lag(step) OVER (PARTITION BY doc_id, kind, depth ORDER BY line_no) AS above FROM depths)",
    ) + (
        "SELECT doc_id, line_no, line, CASE WHEN step = 1 THEN 'not closed' ELSE 'not opened' END AS problem FROM pairs WHERE CASE WHEN kind = '#' THEN (step = 1 AND coalesce(below, 1) = 1) OR (step = -1 AND coalesce(above, -1) = -1) "
        "WHEN step = 1 THEN NOT (coalesce(next_step, 0) = -1 AND next_kind = kind) ELSE NOT (coalesce(last_step, 0) = 1 AND last_kind = kind) END UNION ALL SELECT doc_id, line_no, line, 'malformed' FROM marks WHERE step = 0"
    )


@query("SEG-04", made=True)
def command_pages(d: Dialect) -> str:
    """Pages that lines with page commands name: .bn and the image's name."""
    command = "^[.]bn +([^ ]+)[.](?:png|jpg)"
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {d.group('line', command, 1)} AS page FROM lines WHERE {d.match('line', command)}"


@query("STR-16 WIN-43", made=True)
def shifted_lines(d: Dialect) -> str:
    """Lines moved to the right by four spaces, and to the left by up to four, never past their text: each line for itself, and a paragraph as a block, which moves no further than its least indent."""
    indent = d.length(d.group("line", "^ *", 0))
    cut = lambda n: f"substr(line, CAST({n} + 1 AS INT))"
    return base.ctes(base.book(d), base.paragraphs(d), f"sized AS (SELECT doc_id, line_no, line, {indent} AS indent, min({indent}) OVER (PARTITION BY doc_id, para) AS least FROM para_marks WHERE NOT is_blank)") + (
        f"SELECT doc_id, line_no, concat('    ', line) AS more, {cut('least(4, indent)')} AS less, {cut('least(4, least)')} AS block_less FROM sized"
    )


@query("AGG-24")
def style_values(d: Dialect) -> str:
    """How often each value of a style attribute occurs over all pages, pages' own and those of their images of text."""
    shown = f"concat(coalesce(html, {d.lit('')}), '<img style=\"width:', {d.string('page_id % 7')}, '0%\">')"
    return f"WITH shown AS (SELECT page_id, {shown} AS html FROM {d.table('pages')}), styles AS ({d.explode('page_id', d.all('html', ' style=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34), 1), 'shown', 'k', 'style')}) SELECT style, count(*) AS n FROM styles GROUP BY style"


@query("ARR-16", made=True)
def compressed_tables(d: Dialect) -> str:
    """Texts as tables without blank rows, rows with their new numbers."""
    return base.ctes(base.lines(d)) + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no, line FROM lines WHERE NOT {base.blank(d)}"
