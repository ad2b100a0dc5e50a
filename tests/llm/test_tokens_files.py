"""op3 and op8: ids against the plain tokenizer, exact round trips of the shards, filter and lookup, packing's rules, the curve."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vellum.llm import packing as P
from vellum.llm import sstable as S
from vellum.llm import tokens
from vellum.session import scratch_path


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    odd = ["", " ", "  a", "a  ", "a b", "it's  we'll\n\n x\t y", "a \n b", " x   y", "é  z", "x\x1c y", "😀 😀😀", "a\nb  c", "<|endoftext|> x <|endoftext|>", "tab\tend ", "1 22 333 a1b2"]
    words = ["the", "Über", "c'est", "12", "x_y", "-", "\n", "", "$$$", "naïve", "\t"]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(150)] + ["word " * 5000]


@pytest.fixture(scope="module")
def plain(texts):
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder(texts, plain, monkeypatch):
    for most in (tokens.REMEMBERED, 3, 0):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        enc = tokens.Encoder(tokens.default_path())
        for at in range(0, len(texts), 40):
            got = enc.encode([t.encode() for t in texts[at : at + 40]])
            assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [p[:-1] for p in plain[at : at + 40]]


def test_shards(spark, texts, plain):
    rows = [(3 * i - 50, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (-50, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string").repartition(3)
    path = scratch_path(spark, "test")
    S.write(df, path, tokens.default_path())
    got = S.read_back(spark, path).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, -50)}
    assert all((by_id[3 * i - 50]["n_tokens"], by_id[3 * i - 50]["ids_crc32"]) == (len(p), crc(p)) for i, p in enumerate(plain) if i)
    found = S.lookup(spark, path, [3 * 20 - 50, -50, 10**6]).collect()
    assert sorted((r["doc_id"], len(r["ids"])) for r in found)[-1] == (10, len(plain[20])) and len(found) == 3
    assert [r["ids"] for r in found if r["doc_id"] == 10] == [plain[20]]


def test_shard_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 100)
    w, keys = S.Writer(2), sorted([S.key_of(i) for i in range(-300, 300, 7)] + [S.key_of(1)] * 60 + [b""])
    records = [r for n, k in enumerate(keys) for r in w.add(k, n.to_bytes(2, "little") * 9)] + list(w.close())
    shard = S.Shard(b"".join(r + b"\n" for r in records))
    assert [k for k, _ in shard] == keys and len(shard._blocks) > 5
    assert len(shard.get(S.key_of(1))) == 61 and len(shard.get(S.key_of(-300))) == 1 and shard.get(S.key_of(2)) == [] and len(shard.get(b"")) == 1
    absent = sum(shard.may_hold(S.key_of(i)) for i in range(1000, 3000))
    assert absent < 100 and all(shard.may_hold(k) for k in keys)


def test_packing(spark, texts, plain):
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(1000, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = P.packed(df, tokens.default_path()).collect()
    ids = dict(enumerate(plain)) | {1000: [0]}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["ids_crc32"] == crc(ids[i][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[i]) for r in own)
    short = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        total = sum(r["length"] for r in own)
        assert total <= own[0]["padded_length"] <= 1024 and own[0]["padded_length"] < 2 * max(total, 1)
        short += total < 1024
    assert short <= 4
    assert P.packed(df.limit(0), tokens.default_path()).count() == 0


def test_curve():
    """Along the curve each step goes to a neighbour, and no place is met twice."""
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = P.hilbert(grid)
    order = np.argsort(key)
    assert len(set(key.tolist())) == len(grid)
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_are_alike():
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 50000, 40) for _ in range(8)]
    docs = [rng.choice(topics[i % 8], 400) for i in range(160)]
    order = np.argsort(P.keys(docs, P.signs(1 << 16)), kind="stable")
    assert (np.diff(order % 8) == 0).mean() > 0.6


def test_no_documents(spark):
    path = scratch_path(spark, "none")
    S.write(spark.createDataFrame([], "doc_id long, text string"), path, tokens.default_path())
    assert S.read_back(spark, path).count() == 0 and S.lookup(spark, path, [1]).count() == 0
