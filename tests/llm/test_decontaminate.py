"""op9 against a plain search, in one part and in several."""

import hashlib
import random
import re

from vellum.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        for at in range(max(1, len(iw) - 9) if iw else 0):
            win = iw[at : at + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def data():
    rng = random.Random(8)
    voc = ["the", "Été", "x9", "b", "c d", "the"]
    items = [(i, "!".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate([3, 10, 12, 25, 1, 30])] + [(7, None), (8, "..."), (9, "x9 b"), (10, "x9 B")]
    docs = [None, "", "?!", "éX9.B the"] + [" ".join(rng.choice(voc) for _ in range(rng.randrange(1, 80))) for _ in range(40)] + ["Foo: " + items[3][1].upper() + " end"]
    return [(i, d, 0) for i, d in enumerate(docs)] + [(44, docs[-1], 1)], items


def test_against_plain_search(spark, monkeypatch):
    rows, items = data()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, runs int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *plain(t, items)) for i, t, _ in rows)
    for size in (D.PART_BYTES, 40):
        monkeypatch.setattr(D, "PART_BYTES", size)
        got = D.contamination(docs, bench).collect()
        assert sorted(tuple(r)[:6] for r in got) == want
        clean = D.clean_documents(docs, bench)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_spans_point_at_the_original(spark):
    docs = spark.createDataFrame([(1, "É Question--One TWO, é!")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "question one two")], "item_id long, text string")
    a, b = map(int, D.contamination(docs, bench).first()["spans"].split(":"))
    assert "É Question--One TWO, é!"[a:b] == "Question--One TWO"


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in D.contamination(docs, bench).collect()] == [False]
    assert D.contamination(docs.limit(0), bench).count() == 0
