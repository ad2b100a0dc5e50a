"""op2: counts against plain Python, host verdicts, odd rows."""

import random
import re

import duckdb

from vellum.llm import host_quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    rep = {i + j for i, t in enumerate(tri) if seen[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "a b", "a b c", "a b c a b c", "é é # $\n\n x \n x ", "a a a a a", "\x1c b\x00c"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) + rng.choice(["\n", "", " \n"]) * 2 for _ in range(60)]
    texts.append(" ".join(rng.choice(["x", "y", "zz"]) for _ in range(20000)))
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {r["doc_id"]: r for r in Q.judged(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t), t
        n, _, _, _, rep = counts(t)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


def _hosts():
    good = " ".join(f"word{i}" for i in range(80))
    bad, mild = good + " $$$" * 40, good + " $" * 60
    rows = [(i, good, "fine", 0) for i in range(300)] + [(1000 + i, bad, "spam", 0) for i in range(300)] + [(2000 + i, good if i % 3 else bad, "mixed", 0) for i in range(300)]
    rows += [(3000, good, "spam", 0), (3001, bad, "fine", 0), (3002, mild, "fine", 0), (3003, mild, "mixed", 0), (3004, mild, "spam", 0), (3005, good, None, 0), (3006, None, None, 0), (3007, mild, "new", 0), (3007, mild, "new", 0)]
    return rows


def plain_rates(rows):
    """Shrunk rates of symbols by host, in plain Python."""
    fails, n = {}, {}
    for _, text, host, _ in rows:
        w, _, s, _, _ = counts(text)
        n[host] = n.get(host, 0) + 1
        fails[host] = fails.get(host, 0) + (10 * s > 3 * w)
    m, total = sum(fails.values()) / sum(n.values()), sum(n.values())
    own = sum(n[h] * (fails[h] / n[h] - m) ** 2 for h in n) / total - m * (1 - m) * len(n) / total
    strength = min(1000, max(1, m * (1 - m) / own - 1))
    return {h: (fails[h] + m * strength) / (n[h] + strength) for h in n}, m


def test_verdicts(spark, monkeypatch):
    """Strong junk goes on any host; mild junk stays on a host that is known to be clean, and goes on mixed, bad and unknown ones; what fails no rule stays on any host."""
    df = spark.createDataFrame(_hosts(), "doc_id long, text string, source string, slack_symbols int")
    for most in (Q.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(Q, "BROADCAST_HOSTS", most)
        rows = Q.judged(df).collect()
        kept = {r["doc_id"]: r["kept"] for r in rows}
        assert len(rows) == 909 and not any(kept[1000 + i] for i in range(300)) and all(kept[i] for i in range(300)) and [kept[2000 + i] for i in range(300)] == [i % 3 > 0 for i in range(300)]
        assert [kept[3000 + i] for i in range(7)] == [True, False, True, False, False, True, False] and not kept[3007]
        whole = Q.kept_documents(df)
        assert whole.columns == df.columns
        assert {r["doc_id"] for r in whole.collect()} == {k for k, v in kept.items() if v}


def test_rates(spark):
    df = spark.createDataFrame(_hosts(), "doc_id long, text string, source string, x int")
    want, m = plain_rates(_hosts())
    for r in Q.host_verdicts(Q.features(df, keep=("source",)), "source").collect():
        assert abs(r["rate_symbols"] - want[r["host"]]) < 1e-9 and abs(r["rate_all"] - r["rate_symbols"]) < 1e-3
        assert abs(r["slack_symbols"] - max(0, 1000 * (1 - max(r["rate_symbols"], r["rate_all"]) / m))) < 3


def test_sql(spark):
    """The SQL joins by doc_id, so ids are unique here."""
    con = duckdb.connect()
    df = spark.createDataFrame(_hosts()[:-1], "doc_id long, text string, source string, x int")
    con.register("documents", df.toPandas())
    assert sorted(con.execute(Q.SQL).fetchall()) == sorted(tuple(r) for r in Q.judged(df).collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.judged(df).count() == 0 and Q.kept_documents(df).count() == 0
