"""Word frequencies and what is read off them: the word-frequency family, spelling and scanno joins, edit distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.near import EDITS, Lexicon
from vellum.plans import base
from vellum.plans.dialect import DUCK, SPARK, Dialect, over_folder
from vellum.plans.publish import native, query
from vellum.session import written

#: Letters and their forms without accents, and ligatures with their two letters.
ACCENTED = "àáâãäåèéêëìíîïñòóôõöùúûüýÿçÀÁÂÃÄÅÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝÇ"
PLAIN = "aaaaaaeeeeiiiinooooouuuuyycAAAAAAEEEEIIIINOOOOOUUUUYC"
LIGATURES = [("æ", "ae"), ("œ", "oe"), ("Æ", "Ae"), ("Œ", "Oe"), ("Æ", "AE"), ("Œ", "OE")]
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Han"]
#: How rare a word has to be to be shown by the spelling check, and how many lines are listed per word.
RARE, LISTED = 3, 5
#: In how many documents a word of the lexicon is, how many words are suggested at most, and for how many rare words a task finds them at once.
KNOWN, SUGGESTED, TOGETHER = 20, 10, 50_000


def fold(d: Dialect, x: str) -> str:
    """Without accents."""
    return d.translate(x, ACCENTED, PLAIN)


def lower(d: Dialect, x: str) -> str:
    return d.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝÇ", "abcdefghijklmnopqrstuvwxyzàáâãäåèéêëìíîïñòóôõöùúûüýç")


def upper(d: Dialect, x: str) -> str:
    return d.translate(x, "abcdefghijklmnopqrstuvwxyzàáâãäåèéêëìíîïñòóôõöùúûüýç", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝÇ")


@query("AGG-01 AGG-02")
def word_counts(d: Dialect) -> str:
    """Every word with its count over all text lines."""
    return base.ctes(base.corpus_words(d)) + "SELECT word, n FROM words"


@query("AGG-03")
def word_totals(d: Dialect) -> str:
    """Total and different words."""
    return base.ctes(base.corpus_words(d)) + "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS different FROM words"


@query("AGG-04", made=True)
def dash_words(d: Dialect) -> str:
    """Words joined by a long dash; suspect where they occur with a hyphen too."""
    pairs = d.all("line", "\\p{L}+(?:--|—)\\p{L}+")
    return base.ctes(base.corpus_words(d), f"dashed AS ({d.explode('doc_id, line_no', pairs, 'text_lines', 'k', 'pair')})") + f"""
SELECT pair, count(*) AS n, coalesce(max(w.n), 0) AS n_hyphen, max(w.n) IS NOT NULL AS suspect FROM dashed LEFT JOIN words w ON w.word = {d.sub('pair', '--|—', '-')} GROUP BY pair"""


@query("AGG-05")
def hyphen_words(d: Dialect) -> str:
    """Hyphenated words with the counts of their forms as one word and as two; suspect where another form occurs."""
    first, rest = d.group("word", "^([^-]+)-(.+)$", 1), d.group("word", "^([^-]+)-(.+)$", 2)
    return base.ctes(
        base.corpus_words(d), "next_words AS (SELECT doc_id, line_no, word, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY token_no) AS following FROM tokens)",
        "pairs AS (SELECT word, following, count(*) AS n FROM next_words WHERE following IS NOT NULL GROUP BY word, following)",
        f"hyphens AS (SELECT word, n, {first} AS a, {rest} AS b FROM words WHERE {d.match('word', '^[^-]+-.+$')} AND NOT {d.match('word', '^[0-9-]+$')})",
    ) + """SELECT h.word, h.n, coalesce(o.n, 0) AS n_joined, coalesce(p.n, 0) AS n_apart, (o.n IS NOT NULL OR p.n IS NOT NULL) AS suspect
FROM hyphens h LEFT JOIN words o ON o.word = concat(h.a, h.b) LEFT JOIN pairs p ON p.word = h.a AND p.following = h.b"""  # fmt: skip


def _filtered(pattern: str, but: str = "") -> object:
    def text(d: Dialect) -> str:
        no = f" AND NOT {d.match('word', but)}" if but else ""
        return base.ctes(base.corpus_words(d)) + f"SELECT word, n FROM words WHERE {d.match('word', pattern)}{no}"

    return text


query("AGG-06 AGG-16", "words_by_pattern", "Words that match a pattern (here: a doubled letter at their end).")(_filtered("(?:ee|oo|ll|ss|nn|tt)$"))
query("AGG-07", "alphanumeric_words", "Words with a digit and a letter.")(lambda d: base.ctes(base.corpus_words(d)) + f"SELECT word, n FROM words WHERE {d.match('word', '[0-9]')} AND {d.match('word', '[^0-9_W]')} AND {d.match('word', chr(92) + 'p{L}')}")
query("AGG-08", "capital_words", "Words of two and more characters with capitals and no small letters.")(lambda d: base.ctes(base.corpus_words(d)) + f"SELECT word, n FROM words WHERE {d.length('word')} > 1 AND {d.match('word', chr(92) + 'p{Lu}')} AND NOT {d.match('word', chr(92) + 'p{Ll}')}")
query("AGG-09", "mixed_case_words", "Words with capitals and small letters that are not just capitalised, part by part.")(
    lambda d: base.ctes(base.corpus_words(d)) + f"SELECT word, n FROM words WHERE {d.match('word', chr(92) + 'p{Lu}')} AND {d.match('word', chr(92) + 'p{Ll}')} AND NOT {d.match('word', '^(?:' + chr(92) + 'p{Lu}?[^' + chr(92) + 'p{Lu}]*)(?:-' + chr(92) + 'p{Lu}?[^' + chr(92) + 'p{Lu}]*)*$')} AND NOT {d.match('word', '^Ma?c' + chr(92) + 'p{Lu}[^' + chr(92) + 'p{Lu}]*$')}"
)
query("AGG-10", "capitalised_words", "A capital and then none.")(_filtered(r"^\p{Lu}\P{Lu}+$"))


@query("AGG-11")
def marked_up_phrases(d: Dialect) -> str:
    """Phrases in bold of the pages with their counts, and how often the bare phrase stands in paragraphs."""
    bold = d.all("coalesce(html, '')", "<b>([^<>]{1,40})<", 1)
    return f"""WITH marked AS ({d.explode('page_id', bold, d.table('pages'), 'k', 'phrase')}), counted AS (SELECT trim(phrase) AS phrase, count(*) AS n FROM marked GROUP BY trim(phrase)),
bare AS ({d.explode('page_id', d.all("coalesce(html, '')", '<p>([^<>.]+)[.]', 1), d.table('pages'), 'k', 'sentence')}), sentences AS (SELECT concat(sentence, '.') AS phrase, count(*) AS n FROM bare GROUP BY concat(sentence, '.'))
SELECT c.phrase, c.n, coalesce(s.n, 0) AS n_bare, s.n IS NOT NULL AS suspect FROM counted c LEFT JOIN sentences s ON s.phrase = c.phrase"""


@query("AGG-12")
def accented_words(d: Dialect) -> str:
    """Words with accents; suspect where other forms of the same letters occur."""
    return base.ctes(base.corpus_words(d), f"folded AS (SELECT word, n, {fold(d, 'word')} AS plain FROM words)", "kinds AS (SELECT plain, count(*) AS forms FROM folded GROUP BY plain)") + "SELECT f.word, f.n, f.plain, k.forms > 1 AS suspect FROM folded f JOIN kinds k ON k.plain = f.plain WHERE f.word <> f.plain"


@query("AGG-13", made=True)
def ligature_words(d: Dialect) -> str:
    """Words with a ligature and their forms with two letters; suspect where these occur."""
    forms = d.values("l", "one, two", LIGATURES)
    return base.ctes(base.corpus_words(d), f"forms AS (SELECT w.word, w.n, replace(w.word, one, two) AS other FROM words w JOIN {forms} ON {d.position('w.word', 'one')} > 0)") + "SELECT DISTINCT f.word, f.n, f.other, o.n IS NOT NULL AS suspect FROM forms f LEFT JOIN words o ON o.word = f.other"


@query("AGG-14")
def character_counts(d: Dialect) -> str:
    """Every character but line ends with its count."""
    return f"WITH chars AS ({d.explode('doc_id', d.all('coalesce(text, ' + d.lit('') + ')', '[^' + chr(92) + 'n]'), d.table('documents'), 'k', 'ch')}) SELECT ch, count(*) AS n FROM chars GROUP BY ch"


@query("AGG-15", made=True)
def mixed_script_words(d: Dialect) -> str:
    """Words with letters of more than one script (digits count as Latin)."""
    kinds = " + ".join(f"CASE WHEN {d.match('word', p)} THEN 1 ELSE 0 END" for p in [r"[\p{Latin}0-9]" if d.name == "duckdb" else r"[\p{IsLatin}0-9]", *((r"\p{%s}" if d.name == "duckdb" else r"\p{Is%s}") % s for s in SCRIPTS[1:])])
    return base.ctes(base.corpus_words(d)) + f"SELECT word, n FROM words WHERE {kinds} > 1"


@query("AGG-17")
def search_modes(d: Dialect) -> str:
    """Whether a word is searched whole or literally: literally where an end is no word character."""
    return base.ctes(base.corpus_words(d)) + f"SELECT word, NOT {d.match('word', '^[^0-9A-Za-z_' + chr(92) + 'p{L}]|[^0-9A-Za-z_' + chr(92) + 'p{L}]$')} AS whole FROM words"


@query("AGG-18 AGG-20")
def line_statistics(d: Dialect) -> str:
    """Per document: lines, longest and shortest, and which kinds of quotes it has."""
    has = lambda p: f"max(CASE WHEN {d.match('line', p)} THEN 1 ELSE 0 END)"
    return base.ctes(base.lines(d)) + f"""
SELECT doc_id, count(*) AS n_lines, max({d.length('line')}) AS longest, min({d.length('line')}) AS shortest,
 CASE WHEN {has('["' + "'" + ']')} = 1 AND {has('[“”‘’]')} = 1 THEN 'both' WHEN {has('[“”‘’]')} = 1 THEN 'curly' WHEN {has('["' + "'" + ']')} = 1 THEN 'straight' ELSE 'none' END AS quotes
FROM lines GROUP BY doc_id"""


@query("AGG-19")
def line_words(d: Dialect) -> str:
    """The second tokenizer: tags, entities, fractions, anchors and italics removed; letters, digits, inner hyphens and apostrophes kept."""
    bare = d.sub(d.sub(d.sub("line", "<[^<>]*>|&#?[0-9A-Za-z]+;", " "), "\\[[0-9A-Z*]{1,3}\\]|[0-9]+/[0-9]+", " "), "_", "")
    return base.ctes(base.lines(d), f"split_lines AS ({d.explode('doc_id, line_no', d.all(bare, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+(?:[-’' + chr(39) + '][' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+)*'), 'lines', 'k', 'word')})") + "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM split_lines GROUP BY word"


@query("AGG-21", made=True)
def hyphen_variants(d: Dialect) -> str:
    """Hyphenated words whose form without hyphens occurs, with the first lines of each."""
    joined = d.sub("word", "-", "")
    return base.ctes(base.corpus_words(d), f"both_forms AS (SELECT h.word, h.n, o.n AS n_joined FROM (SELECT word, n, {joined} AS other FROM words WHERE {d.match('word', '.-.')}) h JOIN words o ON o.word = h.other)",
        "spots AS (SELECT DISTINCT t.word, t.doc_id, t.line_no FROM tokens t JOIN both_forms b ON b.word = t.word)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id, line_no) AS k FROM spots)") + f"""
SELECT b.word, b.n, b.n_joined, r.doc_id, r.line_no FROM both_forms b JOIN ranked r ON r.word = b.word WHERE r.k <= {LISTED}"""  # fmt: skip


@query("AGG-22", made=True)
def odd_characters(d: Dialect) -> str:
    """Characters outside plain Latin text with their counts and first place; Greek left out where a document has more than five different Greek letters."""
    odd = d.all("line", "[^ -~ -ÿœŒ‘’“”—–]")
    greek = d.match("ch", r"\p{Greek}" if d.name == "duckdb" else r"\p{IsGreek}")
    return base.ctes(base.lines(d), f"odd AS ({d.explode('doc_id, line_no', odd, 'lines', 'k', 'ch')})", f"greek AS (SELECT doc_id, count(DISTINCT ch) AS n FROM odd WHERE {greek} GROUP BY doc_id)") + f"""
SELECT ch, count(*) AS n, min(o.doc_id) AS first_doc FROM odd o LEFT JOIN greek g ON g.doc_id = o.doc_id WHERE NOT ({greek} AND coalesce(g.n, 0) > 5) GROUP BY ch"""


def _lexicon(d: Dialect) -> str:
    """The lexicon of the checks below: words that twenty documents or more have."""
    return f"lexicon AS (SELECT word FROM words WHERE docs >= {KNOWN})"


def _good(d: Dialect, x: str = "word") -> str:
    """Other forms that are good when they are in the lexicon: small, small behind the first, the other apostrophe."""
    return d.array(x, lower(d, x), f"concat(substr({x}, 1, 1), {lower(d, f'substr({x}, 2)')})", f"replace({x}, '’', {d.lit(chr(39))})", f"replace({x}, {d.lit(chr(39))}, '’')")


@query("JOI-01 JOI-02 JOI-03 JOI-04 JOI-05 AGG-23")
def misspellings(d: Dialect) -> str:
    """Words that no form of is in the lexicon, nor both parts beside an inner apostrophe, ordinals, years and decades left out, with counts up to the threshold and every place."""
    inner = "^([^'’]+)['’](.+)$"
    number = "^(?:[0-9]+(?:st|nd|rd|th|s|d)?|[0-9]{4}['’]?s|sc)$"
    return base.ctes(base.corpus_words(d, docs=True), _lexicon(d), f"forms AS ({d.explode('word, n', _good(d), 'words', 'k', 'form')})", f"parts AS (SELECT word, {d.group('word', inner, 1)} AS a, {d.group('word', inner, 2)} AS b FROM words WHERE {d.match('word', inner)})", "known AS (SELECT f.word FROM forms f JOIN lexicon l ON l.word = f.form UNION SELECT p.word FROM parts p JOIN lexicon a ON a.word = p.a JOIN lexicon b ON b.word = p.b)",
        f"bad AS (SELECT w.word, w.n FROM words w LEFT JOIN known k ON k.word = w.word WHERE k.word IS NULL AND NOT {d.match('w.word', number)} AND w.n <= {RARE})") + "SELECT b.word, b.n, t.doc_id, t.line_no, t.token_no FROM bad b JOIN tokens t ON t.word = b.word"


def _deletions(d: Dialect, x: str) -> str:
    """A word and all words with one letter less."""
    return f"concat({d.array(x)}, {d.each(d.seq('1', d.length(x)), 'i', f'concat(substr({x}, 1, CAST(i - 1 AS INT)), substr({x}, CAST(i + 1 AS INT)))')})" if d.name == "spark" else f"list_concat({d.array(x)}, {d.each(d.seq('1', d.length(x)), 'i', f'concat(substr({x}, 1, i - 1), substr({x}, i + 1))')})"


def _near(d: Dialect) -> str:
    """Pairs of a rare word and a lexicon word at one edit: both give the same form without the letter at the same place, or one is the other without a letter."""
    ok = f"{d.length('word')} > 1 AND NOT {d.match('word', '[0-9]')}"
    return f"""suspects AS (SELECT word, n, {lower(d, 'word')} AS low FROM words WHERE n <= {RARE} AND {ok}),
good AS (SELECT DISTINCT {lower(d, 'word')} AS low FROM lexicon WHERE {ok}),
suspect_keys AS ({d.explode('word, n, low', _deletions(d, 'low'), 'suspects', 'k', 'form')}),
good_keys AS ({d.explode('low', _deletions(d, 'low'), 'good', 'k', 'form')}),
near AS (SELECT DISTINCT s.word, s.n, g.low AS other FROM suspect_keys s JOIN good_keys g ON g.form = s.form AND (g.k = s.k OR least(g.k, s.k) = 1) WHERE s.low <> g.low)"""


def _rare_and_known(d: Dialect) -> str:
    """word, low (in small letters), rare: the rare words and those of the lexicon."""
    return base.ctes(base.corpus_words(d, docs=True)) + f"SELECT word, {lower(d, 'word')} AS low, n <= {RARE} AS rare FROM words WHERE n <= {RARE} OR docs >= {KNOWN}"


def _suggestion(d: Dialect) -> str:
    return f"CASE WHEN {d.match('word', '^' + chr(92) + 'p{Lu}')} THEN concat({d.upper('substr(other, 1, 1)')}, substr(other, 2)) ELSE other END"


def _suggestions_sql(d: Dialect) -> str:
    """The same by comparing all words of like length. DuckDB compares bytes: where a letter has more than one, those of the lexicon word become signs of one byte each, and all others the same sign."""
    letters = d.join(d.distinct(d.each(d.seq("1", d.length("other")), "i", "substr(other, i, 1)")), "")
    signs = d.lit("".join(chr(i) for i in range(32, 126)))
    coded = f"translate(translate(s.low, translate(s.low, g.letters, ''), {d.repeat(d.lit('~'), d.length('s.low'))}), g.letters, {signs})"
    plain = lambda x: f"strlen({x}) = length({x})"
    return base.ctes(
        f"listed AS ({_rare_and_known(d)})", "rare_words AS (SELECT word, low FROM listed WHERE rare)",
        f"good AS (SELECT other, {d.length('other')} AS size, letters, translate(other, letters, {signs}) AS code FROM (SELECT other, {letters} AS letters FROM (SELECT DISTINCT low AS other FROM listed WHERE NOT rare) o) l)",
        f"sizes AS (SELECT low, {d.length('low')} + step AS size FROM (SELECT DISTINCT low FROM rare_words) r, {d.values('steps', 'step', [(i,) for i in range(-EDITS, EDITS + 1)])})",
        f"apart AS (SELECT s.low, g.other, CASE WHEN {plain('s.low')} AND {plain('g.other')} THEN levenshtein(s.low, g.other) ELSE levenshtein({coded}, g.code) END AS edits FROM sizes s JOIN good g ON g.size = s.size WHERE s.low <> g.other)",
        f"ranked AS (SELECT r.word, a.other, row_number() OVER (PARTITION BY r.word ORDER BY a.edits, a.other) AS k FROM rare_words r JOIN apart a ON a.low = r.low WHERE a.edits <= {EDITS})",
    ) + f"SELECT word, {_suggestion(d)} AS suggestion, k FROM ranked WHERE k <= {SUGGESTED}"


def suggested(words: DataFrame) -> DataFrame:
    """word, suggestion and its rank k for the rare ones of words (word, low, rare); the others are the lexicon. The lexicon goes to every task whole, and a task finds all neighbours of its words: no pair is shuffled."""
    words = written(words, "words")
    spark = words.sparkSession
    rare = words.where("rare").select("word", "low")
    lexicon = spark.sparkContext.broadcast(Lexicon(sorted(words.where("NOT rare").select("low").distinct().toArrow()["low"].to_pylist())))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            at, place, rank = lexicon.value.nearest(table["low"].to_pylist(), SUGGESTED)
            out = pa.table({"word": table["word"].take(pa.array(at)), "other": pa.array([lexicon.value.words[i] for i in place.tolist()], pa.string()), "k": pa.array(rank, pa.int32())})
            return iter(out.combine_chunks().to_batches(max_chunksize=10_000))

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                yield from found()
                held = []
        if held:
            yield from found()

    parts = max(spark.sparkContext.defaultParallelism, -(-rare.count() // TOGETHER))
    return rare.repartition(parts, "word").mapInArrow(neighbours, "word string, other string, k int").selectExpr("word", f"{_suggestion(SPARK)} AS suggestion", "k")


@native("JOI-06", "suggestions", sql=_suggestions_sql(DUCK))
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten lexicon words nearest to a rare word within three edits, fewest edits first, then in alphabetical order, with the word's capital restored. Words of any length and letters; one that differs only in capitals is no suggestion."""
    return suggested(over_folder(_rare_and_known)(spark, sf_dir))


@query("JOI-07")
def edit_distance_pairs(d: Dialect) -> str:
    """Rare words at edit distance one of a lexicon word, with the count of both. Candidates meet by a shared form with one letter less, so no pair of words is compared without one."""
    return base.ctes(base.corpus_words(d, docs=True), _lexicon(d), _near(d), f"totals AS (SELECT {lower(d, 'word')} AS low, sum(n) AS n FROM words GROUP BY {lower(d, 'word')})") + "SELECT x.word, x.n, x.other, CAST(t.n AS BIGINT) AS n_other FROM near x JOIN totals t ON t.low = x.other"


@query("JOI-07", "edit_distance_two")
def edit_distance_two(d: Dialect) -> str:
    """Rare words of 6 to 12 plain letters at edit distance two of a lexicon word. Two words at distance two have a common form with at most two letters less; who shares one is compared."""
    two = f"flatten({d.each(_deletions(d, 'low'), 'x', _deletions(d, 'x'))})"
    ok = d.match(lower(d, "word"), "^[a-z]{6,12}$")
    return base.ctes(base.corpus_words(d, docs=True), _lexicon(d), f"suspects AS (SELECT word, n, {lower(d, 'word')} AS low FROM words WHERE n <= {RARE} AND {ok})", f"good AS (SELECT DISTINCT {lower(d, 'word')} AS low FROM lexicon WHERE {ok})",
        f"good_keys AS ({d.explode('low', d.distinct(two), 'good', 'k', 'form')})", f"suspect_keys AS ({d.explode('word, n, low', d.distinct(two), 'suspects', 'k', 'form')})",
        "met AS (SELECT DISTINCT s.word, s.n, s.low, g.low AS other FROM suspect_keys s JOIN good_keys g ON g.form = s.form)") + "SELECT word, n, other FROM met WHERE levenshtein(low, other) = 2"


#: Common confusions of the scanner, with their corrections.
SCANNOS = [("arid", "and"), ("tbe", "the"), ("tiie", "the"), ("wbich", "which"), ("bave", "have"), ("hare", "have"), ("thr", "the"), ("thth", "that"), ("ofthe", "of the"), ("tion", "ation"), ("ia", "is"), ("ahd", "and"), ("ou", "you"), ("nd", "and"), ("rn", "m")]
#: Words in the old spelling with long s read as f; an asterisk marks those that are words themselves.
LONG_S = [("fame", "same", 1), ("fo", "so", 0), ("feems", "seems", 0), ("moft", "most", 0), ("firft", "first", 0), ("alfo", "also", 0), ("fuch", "such", 0), ("thefe", "these", 0), ("for", "sor", 1), ("of", "os", 1)]


@query("JOI-13 JOI-14 CFG-03")
def scannos(d: Dialect) -> str:
    """Confused words, each once per line, at most five lines per word and document, with the correction."""
    rules = d.values("s", "wrong, meant", SCANNOS)
    return base.ctes(base.corpus_words(d), f"hits AS (SELECT DISTINCT t.doc_id, t.line_no, s.wrong, s.meant FROM tokens t JOIN {rules} ON s.wrong = {lower(d, 't.word')})", "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, wrong ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id, wrong) AS n_lines FROM hits)") + f"SELECT doc_id, wrong, meant, line_no, n_lines FROM ranked WHERE k <= {LISTED}"


@query("JOI-15")
def long_s(d: Dialect) -> str:
    """Words in which a long s was read as f; capitals stay, ambiguous ones are marked."""
    rules = d.values("s", "wrong, meant, unsure", LONG_S)
    same = f"CASE WHEN t.word = {lower(d, 't.word')} THEN s.meant WHEN t.word = {d.upper('t.word')} AND {d.length('t.word')} > 1 THEN {d.upper('s.meant')} ELSE concat({d.upper('substr(s.meant, 1, 1)')}, substr(s.meant, 2)) END"
    return base.ctes(base.corpus_words(d)) + f"SELECT t.word, {same} AS meant, s.unsure = 1 AS unsure, count(*) AS n FROM tokens t JOIN {rules} ON s.wrong = {lower(d, 't.word')} GROUP BY t.word, {same}, s.unsure"


@query("RES-16")
def word_list_report(d: Dialect) -> str:
    """The word list's lines as the report shows them, every word, counts aligned to the right; word_list_orders has them in each order with their places."""
    return base.ctes(base.corpus_words(d)) + f"SELECT n, word, concat(lpad({d.string('n')}, 8, ' '), '  ', word) AS line FROM words"


#: Letters that don't fall into a letter and a mark.
_OUTLIERS = str.maketrans(dict(zip("æ ǽ đ ð ƒ ħ ı ł ø ǿ œ ß ŧ Æ Ǽ Ð Ƒ Ħ I Ł Ø Ǿ Œ ẞ Ŧ Þ þ".split(), "ae ae d d f h i l o o oe ss t AE AE D F H I L O O OE SS T TH th".split())))


def _bare(word: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.translate(_OUTLIERS)) if not unicodedata.combining(c))


def _sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with its count, its letters without diacritics, small and as they are."""
    for batch in batches:
        plain = [_bare(w) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w.lower() for w in plain], pa.string()), pa.array(plain, pa.string())], ["word", "n", "low", "plain"])


def listed(words: DataFrame) -> DataFrame:
    """sorted_by (letters, count, length), place and line of every one of the words (word, n). Rows are sorted by ranges; a row's place is its place in the range and the sizes of those before."""
    keyed = written(words.select("word", "n").mapInArrow(_sort_keys, "word string, n long, low string, plain string"), "words")
    total = keyed.agg(F.count("*").alias("v"), F.max("n").alias("most")).first()
    orders = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("sorted_by"), x.cast("long").alias("first")) for k, (name, x) in enumerate((("letters", F.lit(0)), ("count", -F.col("n")), ("length", -F.char_length("word"))))))
    keys = ["k", "first", "low", "plain", "word"]
    rows = keyed.withColumn("_o", F.explode(orders)).select("_o.*", "word", "n", "low", "plain").repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(rows.select("sorted_by", "word", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "listed")
    before, at = [], 0
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], at))
        at += r["count"]
    offsets = words.sparkSession.createDataFrame(before, "part int, before long")
    line = F.concat(F.lpad(F.col("n").cast("string"), len(str(total["most"] or 0)), " "), F.lit("  "), F.col("word"))
    return ranged.join(F.broadcast(offsets), "part").select("sorted_by", ((F.col("at") + F.col("before")) % F.lit(max(1, total["v"])) + 1).alias("place"), line.alias("line"))


@native("RES-16", "word_list_orders")
def word_list_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole word list as the report shows it, by letters, by falling count and by falling length; counts aligned to the right."""
    return listed(over_folder(word_counts)(spark, sf_dir))


@query("JOI-08 JOI-09 JOI-10 JOI-11 JOI-12")
def phrase_suspects(d: Dialect) -> str:
    """A word that a partner is often read for (en/er), in a phrase of three whose form with the partner is more frequent in the corpus; with both counts. Phrases of two decide where that of three is unknown."""
    swap = lambda x: f"CASE {x} WHEN 'en' THEN 'er' WHEN 'er' THEN 'en' WHEN 'he' THEN 'be' WHEN 'be' THEN 'he' END"
    return base.ctes(base.corpus_words(d), f"seq AS (SELECT doc_id, line_no, token_no, {lower(d, 'word')} AS w, {lower(d, 'lag(word) OVER (PARTITION BY doc_id, line_no ORDER BY token_no)')} AS a, {lower(d, 'lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY token_no)')} AS b FROM tokens)",
        "three AS (SELECT a, w, b, count(*) AS n FROM seq WHERE a IS NOT NULL AND b IS NOT NULL AND w IN ('en', 'er', 'he', 'be') GROUP BY a, w, b)", "two AS (SELECT w, b, count(*) AS n FROM seq WHERE b IS NOT NULL AND w IN ('en', 'er', 'he', 'be') GROUP BY w, b)") + f"""
SELECT t.a, t.w, t.b, t.n, coalesce(o.n, 0) AS n_swapped, coalesce(p.n, 0) AS n_two, coalesce(q.n, 0) AS n_two_swapped
FROM three t LEFT JOIN three o ON o.a = t.a AND o.b = t.b AND o.w = {swap('t.w')} LEFT JOIN two p ON p.w = t.w AND p.b = t.b LEFT JOIN two q ON q.b = t.b AND q.w = {swap('t.w')}
WHERE coalesce(o.n, 0) > t.n OR (o.n IS NULL AND coalesce(q.n, 0) > 4 * coalesce(p.n, 0))"""  # fmt: skip
