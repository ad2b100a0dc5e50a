"""op5 against brute force over all pairs, with and without large buckets; components against a plain search."""

import random
import re

import xxhash
from vellum.llm import simhash as S
from vellum.llm.graph import components


def plain_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and find(a) != find(b):
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}É" for i in range(300)]
    out = [None, "", " \n", "a", "One two", "a b c", "A b C", "a b c d", "x " * 3000]
    for _ in range(25):
        t = [rng.choice(vocabulary) for _ in range(rng.choice([30, 400]))]
        for _ in range(6):
            out.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
    return out + out[4:7]


def test_against_all_pairs(spark):
    data = texts()
    rows = [(i + 5, t, 1) for i, t in enumerate(data)]
    got = {r["doc_id"]: r for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    prints = {i + 5: plain_print(t) for i, t in enumerate(data)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(prints)


def test_split_and_ball_find_the_same(spark, monkeypatch):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    prints = dict(enumerate(sorted(fps)))
    want = plain_components(prints)
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    back = {S._signed(x): i for i, x in prints.items()}
    for bucket in (64, 4, 1):
        monkeypatch.setattr(S, "BUCKET", bucket)
        # The workers read the constant from their own import, so the functions run here.
        words = S._split_words(df).orderBy("word").toArrow().to_batches(max_chunksize=37)
        found = [r for b in S._verified(iter(words)) for r in b.to_pylist()]
        edges = [(r["u"], r["v"]) for r in found if r["v"] is not None]
        large = spark.createDataFrame([(r["u"],) for r in found if r["v"] is None] or [(0,)], "fp long").distinct()
        assert (bucket == 64) == all(r["v"] is not None for r in found)
        if bucket < 64:
            balls = S._ball_words(large).orderBy("word", "fp").toArrow().to_batches(max_chunksize=5000)
            edges += [(r["u"], r["v"]) for b in S._stars(iter(balls)) for r in b.to_pylist() if r["u"] in back and r["v"] in back]
        root = {i: i for i in prints}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in edges:
            assert (u ^ v & (1 << 64) - 1) is not None and ((u ^ v) & (1 << 64) - 1).bit_count() <= 4
            a, b = find(back[u]), find(back[v])
            root[max(a, b)] = min(a, b)
        assert {i: find(i) for i in prints} == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)] + [(7, 7), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    root = {n: n for n in nodes}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in nodes} == root


def test_deduplicated(spark):
    rows = [(1, "a b c d e", 0), (2, "a b c d e", 1), (3, "other words are here now", 2), (3, "other words are here now", 2), (None, "a b c d e", 4), (5, None, 5), (6, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    out = S.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["_n"]) for r in out.collect()) == [(0, 4), (1, 0), (3, 2), (5, 5)]
    assert S.near_duplicates(df.limit(0)).count() == 0
