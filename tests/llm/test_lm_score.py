"""op7: base figures and the model's score against plain Python; the codes; held-out text against shuffled letters."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import lm_score as L

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*(w.encode() for w in WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))), b""]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["the", "Cat", "sat", "on", "a", "mat", "été", "x\x1cy", "zebra"]
    out = [(i, " ".join(rng.choice(words[: rng.randrange(2, 9)]) for _ in range(rng.randrange(60)))) for i in range(70)]
    return out + [(70, None), (71, ""), (72, "\n\t "), (73, "Unseen wörds hére " * 40), (2, out[2][1]), (2, out[2][1]), (None, "null id")]


def plain_scores(model, rows):
    """Exact counts of every node in every context, then one decision after the other."""
    codes, counts, taken = model.codes, Counter(), Counter()
    ranks, end = {bytes(w): codes.leaf[i] for i, w in enumerate(codes.words.to_pylist())}, codes.n

    def decisions(text):
        """Node in its tree, bit, and the node in its contexts: none, short, long."""
        symbols = [int(s) for t in tokens(text) for s in ([ranks[t]] if t in ranks else [codes.escape, *codes.bytes_at[list(t)], codes.stop])]
        for i, s in enumerate(symbols):
            last = [symbols[i - k] if i >= k else end for k in (1, 2, 3)]
            spells = s >= codes.n_words
            way = [int(codes.code[s]) >> 51 - k & 1 for k in range(codes.sizes[s])]
            for k, bit in enumerate(way):
                node = (spells, *way[:k])
                yield spells, bit, [(0, node), (1, node, *last[: 2 if spells else 1]), (2, node, *last[: 3 if spells else 2]) if spells or codes.frequent[last[0]] else None]

    for i, x in rows:
        if not L.held_out(i):
            for _, bit, places in decisions(x):
                for place in filter(None, places):
                    counts[place] += 1
                    taken[place] += bit
    for _, x in rows:
        weights, score = model.weights.T.copy(), 0.0
        grad, times, inner, rounds = np.zeros_like(weights), np.zeros(L.GATES), 0, 0
        for spells, bit, places in decisions(x):
            x = np.array([math.log((taken[p] + L.PRIOR) / (counts[p] - taken[p] + L.PRIOR)) for p in places])
            # Strengths towards the way are rounded; those without a context aren't.
            x[1:] = [(1 if bit else -1) * round(max(-32, min(31, (v if bit else -v) * L.GRAIN))) / L.GRAIN for v in x[1:]]
            one, two = (sum(counts[p] >= c for c in L.CLASSES) for p in places[1:])
            g = one * 4 + two + 16 * (1 if spells else 2 * (places[2] is None))
            p = 1 / (1 + math.exp(-max(-12, min(12, float(weights[g] @ x)))))
            score += math.log10(p if bit else 1 - p)
            grad[g] += (bit - p) * x
            times[g] += 1
            inner += 1
            if inner == (L.ROUND if rounds < L.EARLY else L.LATER):
                weights += L.STEP * grad / np.sqrt(np.maximum(1, times))[:, None]
                grad[:], times[:], inner, rounds = 0, 0, 0, rounds + 1
        yield score


@pytest.mark.parametrize("vocabulary, hot, ranges", [(L.VOCABULARY, L.HOT, L.RANGE), (5, 20, 200), (4, 1, 50)])
def test_scores(spark, rows, monkeypatch, vocabulary, hot, ranges):
    """Base and score are those of plain Python, whatever the vocabulary, the hot contexts and the ranges."""
    monkeypatch.setattr(L, "VOCABULARY", vocabulary)
    monkeypatch.setattr(L, "HOT", hot)
    monkeypatch.setattr(L, "RANGE", ranges)
    monkeypatch.setattr(L, "PART", 300)
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, token string").repartition(3)
    c = Counter(t for i, x in rows if not L.held_out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    model = L.trained(df.select("doc_id", df.text.cast("binary").alias("text")))[0]
    assert model.codes.hot.any() or hot == 1
    want = dict(zip((i for i, _ in rows), plain_scores(model, rows)))
    got = L.scored(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (L.held_out(r["doc_id"]), len(t), sum(x in c for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), abs=1e-9)
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=5e-4, abs=5e-3)


def test_very_long_and_many_different(spark):
    """A text of a unit's size beside short ones; deep trees by counts like Fibonacci's numbers."""
    fib = [1, 1]
    while len(fib) < 22:
        fib.append(fib[-1] + fib[-2])
    long = " ".join(f"w{i} " * k for i, k in enumerate(fib))
    ids = [i for i in range(20) if not L.held_out(i)][:3]
    rows = [(ids[0], long), (ids[1], "w1 w2 neverseen"), (ids[2], "")]
    model = L.trained(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "CAST(text AS BINARY) AS text"))[0]
    assert model.codes.sizes[: model.codes.n_words].max() > L.SPLIT
    got = {r["doc_id"]: r["score"] for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), want in zip(rows, plain_scores(model, rows)):
        assert got[i] == pytest.approx(want, rel=2e-3, abs=5e-3)


def test_counts_above_32_bits():
    """Counts are 64-bit: odds of big counts stay what they are."""
    codes = L.Codes(pa.array([b"a", b"b", b"c", b"d"]), np.array([9, 5, 2, 1]), np.ones(258, np.int64), 18)
    a, b = sorted(codes.leaf[:4])[:2]
    context = np.full(2, 7 << 40, np.uint64)
    small, big = (L.ways(codes, codes.key(context, np.array([a, b])), np.array([2, 3]) * k) for k in (100, 10**13))
    second = codes.sizes[a]
    assert small[0] >> 2 == big[0] >> 2 and small[second] >> 2 == big[second] >> 2 and 0 < big[second] >> 2 < 31
    assert L._steps(np.array([10**14]), np.array([4 * 10**13])) == L._steps(np.array([10**6]), np.array([4 * 10**5]))


def test_weights_are_fitted_to_training_texts_only(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["ba", "ti", "on", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)).encode()) for i in range(60)]
    other = [(i, b"x" * 50 if L.held_out(i) else x) for i, x in rows]
    a, b = (L.trained(spark.createDataFrame(r, "doc_id long, text binary"))[0] for r in (rows, other))
    assert np.array_equal(a.weights, b.weights) and not np.array_equal(a.weights, L.starting_weights())


def test_codes_are_complete():
    codes = L.Codes(pa.array([b"a", b"", b"bc", b"d"]), np.array([9, 5, 2, 1]), np.arange(258), 17)
    words, spelled = codes.sizes[: codes.n_words], codes.sizes[codes.n_words :]
    assert sum(2.0**-s for s in words.tolist()) == 1 and sum(2.0**-s for s in spelled.tolist()) == 1 and len(spelled) == 257
    assert len({(i < codes.n_words, c) for i, c in enumerate(codes.code.tolist())}) == len(codes.sizes)
    assert sorted(codes.leaf.tolist()) == list(range(codes.n)) and codes.stop >= codes.n_words > codes.escape


def test_no_training_and_empty(spark):
    held = next(i for i in range(100) if L.held_out(i))
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = L.scored(df).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0
    assert L.scored(df.limit(0)).count() == 0


def test_held_out_words_beat_shuffled_letters(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice(["ba", "ti", "on", "re"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(120)]
    held = next(i for i in range(1000, 1100) if L.held_out(i))
    shuffled = "".join(rng.sample(rows[0][1], len(rows[0][1])))
    fresh = next(i for i in range(held + 1, 1200) if L.held_out(i))
    more = [(held, " ".join(rng.choice(words) for _ in range(120))), (fresh, shuffled)]
    got = {r["doc_id"]: r["bits_per_byte"] for r in L.scored(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    assert got[held] < 0.75 * got[fresh]


def test_bytes_say_counts():
    """Strength and class of any counts, and what is left without one that took the way: exactly in the first class and where all took it."""
    six = lambda n, t: L._six(L._rounded(n, t), np.searchsorted(L.CLASSES, n, side="right"))
    for n in [*range(200), 10**5, 10**8, 10**13]:
        taken = np.unique(np.clip(np.concatenate([np.arange(40), n - np.arange(40), (n * np.linspace(0, 1, 40)).astype(int)]), 0, n))
        many = np.full(len(taken), n)
        byte = L._steps(many, taken)
        assert np.allclose(L._SAYS[byte] * L.GRAIN, L._rounded(many, taken), atol=1e-4)
        assert (L._CLASS[byte] == np.searchsorted(L.CLASSES, many, side="right")).all()
        exact = (taken > 0) & ((n < 4) | ((taken == n) & (n < 32)))
        assert (L._LESS[byte][exact] == six(many[exact] - 1, taken[exact] - 1)).all()


def test_weights_are_fitted_to_every_training_text(spark, rows):
    """Long texts, null ids and repeated rows too: the cells are those of plain Python over all training texts, each decision without itself."""
    rng = random.Random(3)
    ids = [i for i in range(100, 200) if not L.held_out(i)]
    rows = [*rows, (ids[0], " ".join(rng.choice(["long", "text", "of", "the", "Cat"]) for _ in range(12000))), *((i, "of few words") for i in ids[1:20])]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    model = L.trained(source)[0]
    codes, counts, taken, met = model.codes, Counter(), Counter(), []
    ranks, end = {bytes(w): codes.leaf[i] for i, w in enumerate(codes.words.to_pylist())}, codes.n
    for _, text in (r for r in rows if not L.held_out(r[0])):
        symbols = [int(s) for t in tokens(text) for s in ([ranks[t]] if t in ranks else [codes.escape, *codes.bytes_at[list(t)], codes.stop])]
        for i, s in enumerate(symbols):
            last, spells = [symbols[i - k] if i >= k else end for k in (1, 2, 3)], s >= codes.n_words
            way = [int(codes.code[s]) >> 51 - k & 1 for k in range(codes.sizes[s])]
            for k, bit in enumerate(way):
                node = (spells, *way[:k])
                places = [(1, node, *last[: 2 if spells else 1]), (2, node, *last[: 3 if spells else 2]) if spells or codes.frequent[last[0]] else None]
                for place in filter(None, places):
                    counts[place] += 1
                    taken[place, bit] += 1
                met.append((int(codes.plain_less[codes.starts[s] + k]), bit, places, 1 if spells else 2 * (places[1] is None)))
    less = lambda p, bit: int(L._LESS[L._steps(np.array([counts[p]]), np.array([taken[p, bit]]))[0]]) if p else 0
    cells = Counter(plain | less(places[0], bit) << 5 | less(places[1], bit) << 11 | kind << 17 for plain, bit, places, kind in met)
    want = sorted(cells.items())
    assert np.allclose(model.weights, L.fitted(np.array([c for c, _ in want]), np.array([n for _, n in want])))
    assert not np.allclose(model.weights, L.starting_weights())


def test_fitted_weights_are_the_best(monkeypatch):
    """No small step from them makes the decisions of the cells more probable."""
    monkeypatch.setattr(L, "FIT_PRIOR", 1e-6)
    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(0, 32, 400) | (43 + rng.integers(-9, 10, 400)) << 5 | (43 + rng.integers(-9, 10, 400)) << 11)
    n = rng.integers(1, 50, len(cells))
    x = np.stack([((cells & 31) - 16) / L.PLAIN_STEPS, ((cells >> 5 & 63) - 43) / L.GRAIN, ((cells >> 11) - 43) / L.GRAIN], axis=1)
    w = L.fitted(cells, n)[:, 15]
    loss = lambda v: n @ np.logaddexp(0, -(x @ v))
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in 0.01 * np.concatenate([np.eye(3), -np.eye(3)]))


def test_many_batches_share_a_look_up(monkeypatch):
    """Counts come in batches of ten thousand; a look-up makes a table of hashes of the whole vocabulary, so there is one for many batches."""
    calls, found = [], L.pc.index_in
    monkeypatch.setattr(L.pc, "index_in", lambda *a, **k: calls.append(1) or found(*a, **k))

    class Known:
        value = pa.array([b"the", b"cat", b""], pa.binary())

    rng = random.Random(6)
    rows = [(rng.choice(["the", "cat", "", "zebra", "é\x00é", f"w{i}"]).encode(), rng.randrange(1, 9)) for i in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows[a : a + 10]], pa.binary()), pa.array([n for _, n in rows[a : a + 10]], pa.int64())], ["token", "n"]) for a in range(0, 500, 10)]
    got = next(L._spelled(Known)(iter([*batches, batches[0].slice(0, 0)])))
    out = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    want = Counter()
    for w, n in rows:
        if w not in (b"the", b"cat", b""):
            for s in (0, *(b + 1 for b in w), 257):
                want[s] += n
    assert {s: n for s, n in out.items() if n} == want and len(calls) == 1


def test_tokens_are_those_of_plain_python():
    bodies = ["", " ", "a", " a\t\tB  a ", "\x0b\r\n", "É É\x1cx", "end\n", "a" * 300, "x y z"]
    words, of, at = L.tokenised([b.encode() for b in bodies])
    got = words.to_pylist()
    assert len(set(got)) == len(got) and at.tolist()[0] == 0 and len(at) == len(bodies) + 1
    assert [[got[k] for k in of[a:b]] for a, b in zip(at, at[1:])] == [tokens(b) for b in bodies]
    words, of, at = L.tokenised([b" ", b""])
    assert (words.to_pylist(), of.tolist(), at.tolist()) == ([b""], [0, 0], [0, 1, 2])
