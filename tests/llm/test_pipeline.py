"""The pipeline against plain versions of its stages."""

import random

import numpy as np
from test_decontaminate import plain as plain_hits
from test_host_quality import counts
from test_secret_scan import expected as plain_spans
from test_simhash import plain_components, plain_print
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import tokens


def documents(rng):
    words = ["".join(rng.choice(["th", "er", "on", "ti", "re", "an"]) for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(30)) for i in range(4)]
    rows = []
    for i in range(60):
        text = make(rng.randrange(40, 200))
        if i % 9 == 0:
            text += "\n" + items[i % 4][1] + " " + make(9)
        if i % 7 == 0:
            text += f'\ntoken = "{rng.getrandbits(160):040x}" ' + make(5)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 5 == 0:
            rows.append((1000 + i, text, "en", "src1", len(text)))
        if i % 6 == 0:
            rows.append((2000 + i, text.replace(" er", " ER", 1) + " more", "en", "src2", len(text) + 5))
    rows += [(3000 + i, make(80) + " $$$" * 60, "en", "spam", 1) for i in range(20)]
    return rows + [(4000, None, None, None, None), (4001, "", "en", "src0", 0), (4002, "abc " * 100, "en", "src0", 400)], items


def test_against_plain_stages(spark, tmp_path):
    rows, items = documents(random.Random(20))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = {r[0]: r for r in rows}

    def rules(t):
        n, chars, symbols, dup, rep = counts(t)
        return n < 50 or 100 * rep > 50 * n, 10 * symbols > 3 * n

    judged = {i: rules(r[1]) for i, r in docs.items()}
    docs = {i: r for i, r in docs.items() if not judged[i][0] and not (r[3] == "spam" and judged[i][1])}
    root = plain_components({i: plain_print(r[1]) for i, r in docs.items()})
    docs = {i: r for i, r in docs.items() if root[i] == i}
    docs = {i: r for i, r in docs.items() if not plain_hits(r[1], items)[-1]}
    order = sorted(docs)
    texts = {}
    for i, (_, spans) in zip(order, plain_spans([docs[i][1] for i in order])):
        out, at = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
            if a > at or not out:
                out += docs[i][1][at:a] + "[SECRET]"
            at = max(at, b)
        texts[i] = out + docs[i][1][at:]
    assert 20 < len(texts) < 60 and any("[SECRET]" in t for t in texts.values())
    tok = Tokenizer.from_file(tokens.default_path())
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}

    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = stage.columns
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == columns
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == texts
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {i: sum(r["length"] for r in p) for i, p in pieces.items()} == {i: len(x) for i, x in want.items()}
    import zlib

    for i, p in pieces.items():
        assert all(zlib.crc32(np.array(want[i][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in p)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
