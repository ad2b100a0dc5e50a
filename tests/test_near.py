"""Words within three edits: against all pairs, and the suggestions of a small text against its SQL."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum import registry
from vellum.functions import near


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "aé漢\U00010400'"])
@pytest.mark.parametrize("longest", [5, 16, 30])
@pytest.mark.parametrize("held", [200, 3 << 20])
def test_nearest(monkeypatch, letters, longest, held):
    monkeypatch.setattr(near, "HELD", held)
    rnd = random.Random(longest)
    some = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, n)))
    known = sorted({some(longest) for _ in range(60)})
    words = [some(longest + 3) for _ in range(30)]
    for word in rnd.choices(known, k=60):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(word))
            word = word[:i] + rnd.choice(["", some(1)]) + word[i + rnd.randint(0, 1) :]
        words.append(word or "a")
    every = [sorted((d, g) for g in known if 1 <= (d := edits(w, g)) <= 3) for w in words]
    for most in (10, 1000):
        at, place, rank = near.Lexicon(known).nearest(words, most)
        got = sorted(zip(at.tolist(), rank.tolist(), (known[i] for i in place)))
        assert got == [(i, k, g) for i, x in enumerate(every) for k, (_, g) in enumerate(x[:most], 1)]


def test_no_words():
    assert [len(x) for x in near.Lexicon([]).nearest(["a"], 10)] == [0, 0, 0] == [len(x) for x in near.Lexicon(["a"]).nearest([], 10)]
    assert near.distances(np.zeros((0, 1), np.uint32), np.zeros((2, 1), np.uint32)).tolist() == [2]


def test_suggestions(spark, tmp_path):
    """Two and three edits, one letter, digits, a long word, letters of several bytes, more than ten neighbours; nearest first."""
    known = ["background", "élève", "i", "1742", "x" * 50 + "y" * 30, *(f"qqqqqq{c}" for c in "abcdefghijklm")]
    rare = {"Bakgruond": "Background", "backgro": "background", "backgr": None, "èlevé": "élève", "2": "i", "1749": "1742", "x" * 52 + "y" * 29: "x" * 50 + "y" * 30, "qqqqqrm": "qqqqqqm"}
    docs = [" ".join(known) + (" " + " ".join(rare) if i == 7 else "") for i in range(25)]
    pq.write_table(pa.table({"doc_id": list(range(25)), "text": docs}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df = registry.queries()["suggestions"](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["suggestions"]).to_arrow_table().select(df.columns).to_pylist()
    got = [r.asDict() for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w: next((r["suggestion"] for r in got if (r["word"], r["k"]) == (w, 1)), None) for w in rare} == rare
    assert [r["suggestion"] for r in sorted(got, key=lambda r: r["k"]) if r["word"] == "qqqqqrm"] == ["qqqqqqm", *(f"qqqqqq{c}" for c in "abcdefghi")]
