"""The whole word list in its three orders against plain Python."""

import random
import unicodedata

from vellum.operators import words as W


def test_every_word_in_each_order(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abcàéÉBñøæß") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 2, 30, 1234567890]) for _ in range(700)}
    assert len(counts) > 400
    bare = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.replace("ø", "o").replace("æ", "ae").replace("ß", "ss")) if not unicodedata.combining(c))
    letters = lambda w: (bare(w).lower(), bare(w), w)
    keys = {"letters": letters, "count": lambda w: (-counts[w], *letters(w)), "length": lambda w: (-len(w), *letters(w))}
    got = W.listed(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()
    assert len(got) == 3 * len(counts)
    for name, key in keys.items():
        assert [r["line"] for r in sorted(got, key=lambda r: r["place"]) if r["sorted_by"] == name] == [f"{counts[w]:>10}  {w}" for w in sorted(counts, key=key)]
        assert sorted(r["place"] for r in got if r["sorted_by"] == name) == list(range(1, len(counts) + 1))


def test_empty(spark):
    assert W.listed(spark.createDataFrame([], "word string, n long")).count() == 0
