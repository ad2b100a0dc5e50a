"""Functions with a state, by example, by property and against all possibilities."""

import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.functions import rewrite as R


def test_templates():
    assert R.replace_all(r"(\w+) (\w+)", r"\2 \1", "a b") == "b a"
    assert R.replace_all(r"(\w+) (\w+)", r"\U\1\E-\T\2\E!", "one two") == "ONE-Two!"
    assert R.replace_all("x", r"\n\t\\", "x") == "\n\t\\"
    assert R.replace_all("(a)|b", r"<\1\9>", "ab") == "<a><>"


def test_title_case():
    assert R.title_case("the SHIP of the line") == "The Ship of the Line"


def plain_cost(words, cut, width):
    lines, at = [], 0
    for n in cut:
        lines.append(" ".join(words[at : at + n]))
        at += n
    if any(len(x) > width and " " in x for x in lines):
        return None
    return sum(0 if i == len(lines) - 1 and len(x) <= width else (width - 1 - len(x)) ** 2 for i, x in enumerate(lines))


def cuts(n):
    for marks in itertools.product([0, 1], repeat=n - 1):
        out, size = [], 1
        for m in marks:
            if m:
                out.append(size)
                size = 0
            size += 1
        yield [*out, size]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9).map(lambda n: "x" * n), min_size=1, max_size=9), st.integers(8, 20))
def test_fill_is_best(words, width):
    lines = R.filled(words, width)
    assert " ".join(lines).split() == words
    cost = plain_cost(words, [len(x.split()) for x in lines], width)
    assert cost == min(c for c in (plain_cost(words, k, width) for k in cuts(len(words))) if c is not None)


def test_rewrap_blocks():
    text = "one two\nthree\n\n/#\nfour five\n/*\n  a\n    b\n*/\n#/\n/$\nas   is\n$/\n/c\nmid\nc/"
    out = R.rewrapped(text, 30).split("\n")
    assert out[0] == "one two three" and "  four five" in out and "      a" in out and "        b" in out and "as   is" in out
    assert out[-1] == "mid".center(30).rstrip()
    assert R.rewrapped("a b\n\nc", 30) == "a b\n\nc" and R.rewrapped("") == ""
    for bad in ("/#\na", "#/", "/$\na\n*/"):
        with pytest.raises(R.BlockError):
            R.rewrapped(bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab abc abcd e".split()), min_size=1, max_size=30).map(" ".join), max_size=4).map("\n\n".join))
def test_rewrap_again_changes_nothing(text):
    once = R.rewrapped(text, 24)
    assert R.rewrapped(once, 24) == once


def test_quotes():
    text, odd = R.curly_quotes("\"Don't,\" he said. 'Twas \"so.\"\n\n\"Open\n\n\"again.\" x \" y")
    assert text.startswith("“Don’t,” he said. ’Twas “so.”\n\n“Open\n\n“again.”") and [w for _, w in odd] == ["floating quote"]
    assert R.curly_quotes('a "b')[1] == [(4, "quote not closed")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=12), st.lists(st.sampled_from("a b c d".split()), max_size=12))
def test_alignment_makes_one_of_the_other(a, b):
    out = []
    for kind, a1, a2, b1, b2 in R.aligned(a, b):
        out += a[a1:a2] if kind == "equal" else b[b1:b2]
    assert out == b
    marked = R.marked_difference(" ".join(a), " ".join(b))
    assert re.sub(r"\[\+(.*?)\+\]", r"\1", re.sub(r"\[-.*?-\]", "", marked)).split() == b


def test_differences():
    assert R.differences("one two\nthree four", "one two\nthree fours") == [("", 2, "s", 2)]
    assert R.differences("A b", "a b", fold=True) == [] and R.differences("", "x") == [("", 0, "x", 1)]


def test_characters():
    assert "é" in R.characters_named("latin small e acute") and R.characters_named("U+2014") == ["—"] and R.characters_named("x") == ["x"]
    assert R.character_name("—") == "EM DASH" and R.unaccented("Éa") == "Ea"


def test_html():
    page = R.to_html("\n\n\n\nTitle\n\n\n\n\nChapter <i>one</i>\n\nA & b -- c\nmore\n\n/$\nx < y\n$/\n-----File: 012.png---\n\n/P\n  verse\nP/", "t")
    for part in ("<h1>Title</h1>", '<div class="chapter">\n<h2>Chapter <em>one</em></h2>', "<p>A &amp; b — c\nmore</p>", "<pre>\nx &lt; y\n</pre>", 'id="Page_012"', '<div class="verse indent2">verse</div>'):
        assert part in page, part


def test_tables():
    rows = [["a", "bb", ""], ["c", "d", "e"]]
    assert R.stepped_to_grid(R.grid_to_stepped(rows)) == rows
    assert R.adjusted_column([["one two three", "x"]], 0, 7) == [["one two", "x"], ["three  ", " "]]


def test_css():
    page = '<p class="a">x</p><b class=b>y</b>'
    assert R.with_css(page, {"a": {"display": "none"}, "b": {"text-transform": "uppercase", "before": "[", "after": "]"}}) == "<b class=b>[Y]</b>"


def test_fixup():
    line = 'a  b - c . d ! e ( f ) " '
    assert R.fixed_up("a  b - c , d ( e ) f lst") == "a b-c, d (e) f 1st"
    kinds = {k for _, k, _, _ in R.fixup_findings(line)}
    assert {"multiple spaces", "spaced hyphen", "spaced full stop", "space before !", "open bracket and space", "space and close bracket", "spaces at the end"} <= kinds
    assert R.fixup_findings("/*\na  b\n*/\n/P\nline  12\nP/\n*  *  *") == []
    assert [k for _, k, _, _ in R.fixup_findings("« a", "fr")] == ["guillemet and space"] and R.fixup_findings("« a", "de") == []


def test_pages_joined():
    assert R.joined_pages("-----File: 1.png---\none wo-\n-----File: 2.png---\nrd two\n-----File: 3.png---\n\nnew") == "one word\ntwo\n\nnew"
    assert R.joined_pages("self-\n-----File: 2.png---\nmade x", frozenset({"self-made"})) == "self-made\nx"
    assert R.joined_pages("a--\n-----File: 2.png---\nb\nc") == "a--b\nc" and R.joined_pages("a\n-----File: 2.png---\nb") == "a\nb" and R.joined_pages("") == ""


def test_footnotes():
    text = "one[A] two[A] [Footnote A: see [x] here]\nthree[B]\n[Footnote B: open\nFOOTNOTES:\nend"
    (s, e, label, anchor), second = R.footnotes(text)
    assert (text[s:e], label, text[anchor : anchor + 3], anchor) == ("[Footnote A: see [x] here]", "A", "[A]", text.rindex("two") + 3)
    assert text[second[0] : second[1]] == "[Footnote B: open"
    assert R.reindexed(text).startswith("one[A] two[1] [Footnote 1: see [x] here]\nthree[2]\n[Footnote 2: ")
    moved = R.footnotes_moved(text)
    assert moved == "one[A] two[A] \nthree[B]\n\nFOOTNOTES:\n\n[Footnote A: see [x] here]\n\n[Footnote B: open\nend"
    assert R.footnotes_moved("x[1]\n[Footnote 1: y]").endswith("FOOTNOTES:\n\n[Footnote 1: y]") and R.footnotes_moved("x") == "x"


def test_edits_and_labels():
    assert R.edited("abcdef", [(0, 1, "X"), (4, 6, ""), (0, 3, "Y"), (2, 2, "-")]) == "Xb-cd"
    assert [R.roman(n) for n in (1, 4, 9, 44, 1999)] == ["I", "IV", "IX", "XLIV", "MCMXCIX"]


def test_phrase_verdicts():
    assert R.phrase_verdict("normal", 1, 3) and not R.phrase_verdict("normal", 3, 1) and not R.phrase_verdict("tolerant", 1, 3) and R.phrase_verdict("tolerant", 0, 1)
    assert R.phrase_verdict("normal", 0, 0) and not R.phrase_verdict("normal", 0, 0, True) and R.phrase_verdict("paranoid", 0, 0, True)


def test_options():
    from vellum.options import Options

    changed = Options().but(long_line=80)
    assert changed.saved() == {"long_line": 80} and Options.loaded({"long_line": 80, "gone": 1}) == changed and Options.loaded({}) == Options()
