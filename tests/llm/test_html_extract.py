"""op6: the cut against all labellings, extraction on written pages with a known article, odd pages."""

import itertools
import random
import time

from vellum.llm import html_extract as H


def test_cut_against_all_labellings():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randrange(1, 10)
        unary = [(rng.randrange(6), rng.randrange(6)) for _ in range(n)]
        joins = {(i, j): rng.randrange(1, 5) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4}
        cost = lambda s: sum(u[0] if x else u[1] for u, x in zip(unary, s)) + sum(c for (i, j), c in joins.items() if s[i] != s[j])
        best = min(map(cost, itertools.product([True, False], repeat=n)))
        assert cost(H.minimum_cut(unary, joins)) == best


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body class="page main">
<header><a href="/">Site name</a><p>Our motto is a long sentence, with words and all of that.</p></header><nav><ul><li><a href="/a">Home</a></li><li><a>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve this site. Please accept them all now.</p></div>
<article><h1>The title &amp; more</h1><p><b>First paragraph with   some words.<br><p>Second&nbsp;paragraph &mdash; with more words in it, and a <a href="x">link</a>.
<div class="ad">Buy now our great new product, it is very cheap.</div><ul><li>One item</li><li>Two items</ul><p>Short.</p><table><tr><td>1<td>2</table>
<form><label>Mail</label><input><p>Sign up for the letter, it comes once a week.</p><button>Go</button></form><blockquote>A quote of someone.</blockquote>
<section id="comments"><h2>Comments</h2><p>Reader one says a long thing about this article, and more.</p></section></article>
<aside class="sidebar"><p>Related things which you may want to read, one and two.</p></aside><footer>&copy; 2020 the site. All rights reserved.</footer></body></html>"""
WANT = "The title & more First paragraph with some words. Second paragraph — with more words in it, and a link. One item Two items Short. 1 2 A quote of someone."


def test_page():
    assert H.main_text(PAGE) == WANT


def test_page_without_article_elements():
    page = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert H.main_text(page) == WANT


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text here" + "</div>" * 3000
    cases = ["", None, "plain words only.", "<", "<p", "a < b and c > d.", "<p>x &lt;b&gt; &#233; &bogus;</p>", "<!-- open", "</p></div>", "<script>never closed", deep, "<p>long word " * 5000, "<table><tr><td>cell</table>"]
    df = spark.createDataFrame([(i, None, c, "z") for i, c in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.extracted(df).collect()}
    assert len(got) == len(cases)
    assert [got[i]["text"] for i in (0, 1, 3, 7, 8, 9)] == ["", "", "<", "", "", ""]
    assert got[2]["text"] == "plain words only." and got[5]["text"] == "a < b and c > d." and got[6]["text"] == "x <b> é &bogus;"
    assert got[11]["text"] == " ".join(["long word"] * 5000) and got[11]["n_chars"] == len(got[11]["text"])
    assert H.extracted(df.limit(0)).count() == 0


def test_tags_and_lists():
    assert H.main_text("<article><p class=it's>Hello there, this is text.</p></article>") == "Hello there, this is text."
    assert H.main_text("<article><p>Some words here.</p><ul><li>one item</li><li><a href=x>two</a></li></ul></article>") == "Some words here. one item two"
    assert H.main_text("<article><p title='a > b' data-x=\"<i>\">One sentence here.</p><object><p>No player.</p></object><p>Another one here.</p></article>") == "One sentence here. Another one here."
    assert H.main_text("<article><p>Before the list.</p><select><option>a<option>b</select><p>Behind it, more words.</p></article>") == "Before the list. Behind it, more words."


def test_pages_of_known_articles():
    """Articles of random blocks among boilerplate of random kinds and places: exactly the article's blocks come out, in order."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice(["ta", "ri", "mon", "el", "us"]) for _ in range(rng.randrange(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    for _ in range(60):
        want, body = [], ""
        for _ in range(rng.randrange(2, 9)):
            s = sentence(rng.randrange(6, 30))
            want.append(s)
            body += rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<div>{}</div>", "<p><b>{}</b></p>", "<p class='lead'>{}</p>"]).replace("{}", s.replace(" ", rng.choice([" ", "  ", "\n", " <i></i>"])))
            if rng.random() < 0.4:
                body += rng.choice(['<div class="advert"><p>{}</p></div>', "<form><p>{}</p></form>", "<script>{}</script>", '<aside>{}</aside>', "<div id='related-posts'><a href='x'>{}</a></div>", "<!-- {} -->"]).replace("{}", sentence(9))
        page = f"<html><head><title>{sentence(4)}</title></head><body><nav><ul><li><a href='/'>{word()}</a></ul></nav><header><p>{sentence(8)}</p></header><article>{body}</article><section class='comments'><p>{sentence(12)}</p></section><footer>{sentence(7)}</footer></body></html>"
        assert H.main_text(page) == " ".join(want), page


def test_hostile_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<div>x " * 100_000, '<a "' * 250_000, "<a b='" * 170_000 + ">", "</x>" * 80_000 + "<div>" * 50_000 + "</y>" * 80_000, "<object>" * 100_000, "<div><li>x" * 50_000, "<!" * 400_000, "<svg>" * 100_000):
        H.main_text(page)
    assert time.time() - began < 20
