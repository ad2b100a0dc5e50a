"""Functions of single texts, each over all lines or words of the documents."""

from __future__ import annotations

from vellum.operators.words import fold, upper
from vellum.plans import base
from vellum.plans.dialect import Dialect
from vellum.plans.publish import query

SLASH = chr(92)
#: Digits and signs with their raised and lowered forms, and fractions with a sign of their own.
RAISED = ("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")
LOWERED = ("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
FRACTIONS = [("1/2", "½"), ("1/3", "⅓"), ("2/3", "⅔"), ("1/4", "¼"), ("3/4", "¾"), ("1/5", "⅕"), ("2/5", "⅖"), ("3/5", "⅗"), ("4/5", "⅘"), ("1/6", "⅙"), ("5/6", "⅚"), ("1/8", "⅛"), ("3/8", "⅜"), ("5/8", "⅝"), ("7/8", "⅞")]
SMALL = ["a", "an", "and", "at", "by", "from", "in", "of", "on", "the", "to"]


def _lines(ids: str, name: str, about: str, x, where=None) -> None:  # noqa: ANN001
    def text(d: Dialect) -> str:
        cond = f" WHERE {where(d)}" if where else ""
        return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {x(d)} AS changed FROM lines{cond}"

    query(ids, name, about)(text)


_lines("STR-01", "unaccented_lines", "Lines without accents.", lambda d: fold(d, "line"), lambda d: d.match("line", "[À-ÿ]"))
_lines("STR-02", "anchor_names", "Lines as anchor names: no accents, one underscore for whatever isn't letter, digit or hyphen.", lambda d: d.sub(fold(d, "line"), "[^0-9A-Za-z-]+", "_"))
_lines("STR-07 STR-08", "replaced_lines", "A pattern replaced by another order of its groups, everywhere.", lambda d: d.sub("line", "([a-z]+), ([a-z]+)", SLASH + "2, " + SLASH + "1"), lambda d: d.match("line", "[a-z], [a-z]"))
_lines("STR-09", "sentence_case", "Small letters with a first capital.", lambda d: f"concat({d.upper('substr(line, 1, 1)')}, {d.lower('substr(line, 2)')})")
_lines("STR-14 STR-54 STR-33", "without_inline_markup", "Without inline markup; italics and bold become signs.", lambda d: d.sub(d.sub(d.sub("line", "</?i>", "_"), "</?b>", "="), "</?(?:[fgu]|sc)>"))
_lines("STR-21 STR-34", "without_notes", "Without proofers' notes and the double spaces they leave.", lambda d: d.sub(d.sub("line", SLASH + "[" + SLASH + "*" + SLASH + "*[^" + SLASH + "]]*" + SLASH + "]"), "  +", " "))
_lines("STR-22 STR-23", "protected_quotes", "Straight quotes masked and back again.", lambda d: d.translate(d.translate("line", "\"'", "␁␂"), "␁␂", "\"'"))
_lines("STR-28 STR-41", "raised_digits", "Digits as raised signs.", lambda d: d.translate("line", *RAISED), lambda d: d.match("line", "[0-9]"))
_lines("STR-29 STR-42", "lowered_digits", "Digits as lowered signs.", lambda d: d.translate("line", *LOWERED), lambda d: d.match("line", "[0-9]"))
_lines("STR-32", "without_block_markup", "Without marks of blocks on lines of their own.", lambda d: d.sub("line", "^(?:/[*#$CFPXLIR]|[*#$CFPXLIR]/)$"))
_lines("STR-36", "without_emphasis", "Without underscores and equals signs around phrases.", lambda d: d.sub("line", "[_=]([^_=]+)[_=]", SLASH + "1"))
_lines("STR-37", "without_thought_breaks", "Without lines of four or more stars.", lambda d: d.sub("line", "^(?: *[*•]){4,} *$"))
_lines("STR-39 STR-40", "unwrapped_notes", "Text of illustrations and sidenotes without their brackets.", lambda d: d.sub("line", SLASH + "[(?:Illustration|Sidenote): ([^" + SLASH + "]]*)" + SLASH + "]", SLASH + "1"))
_lines("STR-55", "marked_ranges", "A function applied to a range of the line: the first ten characters in capitals.", lambda d: f"concat({upper(d, 'substr(line, 1, 10)')}, substr(line, 11))")
_lines("HTM-41", "entities", "Signs of HTML as entities, double hyphens as dashes.", lambda d: d.sub(d.sub(d.sub(d.sub("line", "&", "&amp;"), "--", "—"), "<", "&lt;"), ">", "&gt;"))
_lines("HTM-43", "inline_elements", "Inline markup as elements.", lambda d: d.sub(d.sub("line", "<(/?)i>", "<" + SLASH + "1em>"), "<(/?)b>", "<" + SLASH + "1strong>"))
_lines("HTM-47", "sub_super", "Raised and lowered text as elements.", lambda d: d.sub(d.sub("line", SLASH + "^" + SLASH + "{([^}]*)" + SLASH + "}", "<sup>" + SLASH + "1</sup>"), "_" + SLASH + "{([^}]*)" + SLASH + "}", "<sub>" + SLASH + "1</sub>"))
_lines("HTM-48", "thought_breaks", "Thought breaks as rules.", lambda d: d.sub("line", "^ *(?:<tb>|(?:[*] *){3,})$", '<hr class="tb">'))
_lines("HTM-65", "number_spaces", "No-break spaces between digits removed.", lambda d: d.sub("line", "([0-9]) ([0-9])", SLASH + "1" + SLASH + "2"))
_lines("ARR-10 ARR-11", "filled_spaces", "Spaces at the ends as a fill sign, and back.", lambda d: d.sub(d.sub("line", "^ | $", "␣"), "␣", " "))
_lines("ARR-17", "auto_columns", "Dividers where two or more spaces stand.", lambda d: d.sub("line", " {2,}", " | "))


@query("STR-03")
def anchor_ids(d: Dialect) -> str:
    """Ids of first lines, unique over the corpus by a number behind those that collide."""
    name = d.sub(d.sub(fold(d, "line"), "<[^<>]*>|&[a-z]+;"), "[^0-9A-Za-z]+", "_")
    return base.ctes(base.lines(d), f"named AS (SELECT doc_id, {name} AS name FROM lines WHERE line_no = 1)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM named)") + f"SELECT doc_id, CASE WHEN k = 1 THEN name ELSE concat(name, '_', {d.string('k')}) END AS id FROM ranked"


@query("STR-06")
def ordinals(d: Dialect) -> str:
    """Numbers to 99 as ordinals in words."""
    ones = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
    tens = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
    one, ten = d.array(*(f"'{x}'" for x in ones)), d.array(*(f"'{x}'" for x in tens))
    numbers = d.explode("x", d.seq("1", "99"), "(SELECT 1 AS x) one_row", "k", "n")
    return f"SELECT n, CASE WHEN n < 20 THEN {d.at(one, 'n')} WHEN n % 10 = 0 THEN concat(substr({d.at(ten, d.intdiv('n', '10') + ' - 1')}, 1, CAST({d.length(d.at(ten, d.intdiv('n', '10') + ' - 1'))} - 1 AS INT)), 'ieth') ELSE concat({d.at(ten, d.intdiv('n', '10') + ' - 1')}, '-', {d.at(one, 'n % 10')}) END AS ordinal FROM ({numbers}) numbers"


@query("STR-10")
def title_case(d: Dialect) -> str:
    """First lines with capitals at all words but small ones; the first word always has one."""
    small = f"w IN ({', '.join(repr(x) for x in SMALL)})"
    cap = f"concat({upper(d, 'substr(w, 1, 1)')}, substr(w, 2))"
    made = d.join(d.each(d.cut(d.lower("line"), " "), "w", f"CASE WHEN {small} THEN w ELSE {cap} END"), " ")
    return base.ctes(base.lines(d)) + f"SELECT doc_id, concat({upper(d, f'substr({made}, 1, 1)')}, substr({made}, 2)) AS title FROM lines WHERE line_no = 1"


@query("STR-11")
def reversed_runs(d: Dialect) -> str:
    """Lines reversed, as text between marks of direction is."""
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {d.reverse('line')} AS changed FROM lines WHERE {d.match('line', '^[ -~]+$')}"


@query("STR-12", made=True)
def fractions(d: Dialect) -> str:
    """Fractions with a sign of their own by it."""
    x = "line"
    for plain, sign in FRACTIONS:
        x = f"replace({x}, '{plain}', '{sign}')"
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {x} AS changed FROM lines WHERE {d.match('line', '[1-7]/[2-8]')}"


@query("STR-15 HTM-44")
def small_capitals(d: Dialect) -> str:
    """Text in small capitals (here: in bold, of pages) in capitals."""
    parts = d.cut("coalesce(html, '')", "<b>|<br>")
    return f"WITH parts AS ({d.explode('page_id', parts, d.table('pages'), 'k', 'part')}) SELECT page_id, k, CASE WHEN k % 2 = 0 THEN upper(part) ELSE part END AS part FROM parts WHERE {d.match('part', '^[ -~]*$')}"


@query("STR-46")
def best_characters(d: Dialect) -> str:
    """Curly quotes and long dashes downgraded where the other text of a pair (here: the next document) has none."""
    has = lambda x: d.match(x, "[‘’“”—]")
    return f"SELECT doc_id, CASE WHEN {has('text')} AND NOT {has('other')} THEN {d.translate('text', '‘’“”—', chr(39) * 2 + chr(34) * 2 + '-')} ELSE text END AS text FROM (SELECT a.doc_id, coalesce(a.text, '') AS text, coalesce(b.text, '') AS other FROM {d.table('documents')} a LEFT JOIN {d.table('documents')} b ON b.doc_id = a.doc_id + 1) t"


@query("STR-47 STR-48")
def token_lines(d: Dialect) -> str:
    """Tokens at white space with the first and last line each is on."""
    return base.ctes(base.lines(d), f"parts AS ({d.explode('doc_id, line_no', d.cut('line', '[ ' + SLASH + 't]+'), 'lines', 'k', 'token')})") + "SELECT doc_id, token, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM parts WHERE token <> '' GROUP BY doc_id, token"


@query("STR-49")
def joined_tokens(d: Dialect) -> str:
    """Words and punctuation cut apart and joined again, with no space before punctuation."""
    tokens = d.join(d.all("line", "[" + SLASH + "p{L}" + SLASH + "p{N}]+|[^ " + SLASH + "p{L}" + SLASH + "p{N}]"), " ")
    return base.ctes(base.lines(d)) + f"SELECT doc_id, line_no, {d.sub(tokens, ' ([.,;:?!)])', SLASH + '1')} AS changed FROM lines"


@query("STR-57")
def good_words(d: Dialect) -> str:
    """The lexicon of a project as a list: words that a hundred documents have."""
    return base.ctes(base.corpus_words(d)) + "SELECT word FROM tokens GROUP BY word HAVING count(DISTINCT doc_id) >= 100"


@query("STR-60")
def plural_counts(d: Dialect) -> str:
    """Counts with their noun in the right number."""
    return base.ctes(base.lines(d)) + f"SELECT doc_id, concat({d.string('count(*)')}, CASE WHEN count(*) = 1 THEN ' line' ELSE ' lines' END) AS said FROM lines GROUP BY doc_id"


@query("JOI-16 JOI-17 SRC-10")
def rule_matches(d: Dialect) -> str:
    """Rules of a file against all texts: how often each is found, and in how many documents; rules that are found nowhere show zero."""
    rules = [(1, " [,;]"), (2, "([a-z])[.]([a-z])"), (3, "zzzz"), (4, "[0-9]{4}")]
    one = " UNION ALL ".join(f"SELECT {i} AS ord, coalesce(sum({d.size(d.all('coalesce(text, ' + d.lit('') + ')', p))}), 0) AS n, coalesce(sum(CASE WHEN {d.match('coalesce(text, ' + d.lit('') + ')', p)} THEN 1 ELSE 0 END), 0) AS n_docs FROM {d.table('documents')}" for i, p in rules)
    return f"SELECT ord, CAST(n AS BIGINT) AS n, CAST(n_docs AS BIGINT) AS n_docs FROM ({one}) r"


@query("JOI-25")
def character_suites(d: Dialect) -> str:
    """The suites that each character is in, and whether one of them is enabled."""
    suites = d.values("s", "suite, chars, enabled", [("basic", "abcdefghijklmnopqrstuvwxyz .,", 1), ("accents", "àáâäçèéêëìíîïñòóôöùúûüß", 1), ("signs", "#$%&*|<>", 0)])
    return f"WITH chars AS ({d.explode('doc_id', d.all('coalesce(' + d.lower('text') + ', ' + d.lit('') + ')', '[^' + SLASH + 'n]'), d.table('documents'), 'k', 'ch')}), kinds AS (SELECT ch, count(*) AS n FROM chars GROUP BY ch) SELECT ch, n, s.suite, s.enabled = 1 AS enabled FROM kinds LEFT JOIN {suites} ON {d.position('s.chars', 'ch')} > 0"
