"""Readers and writers on files of their own."""

import gzip
import json

from vellum.sources import readers as S


def test_documents_and_side_cars(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿é one\r\ntwo".encode())
    (tmp_path / "b.txt").write_bytes("é two".encode("latin-1"))
    import hashlib

    (tmp_path / "a.txt.json").write_text(json.dumps({"md5checksum": hashlib.md5("é one\ntwo".encode()).hexdigest(), "languages": "fr", "pagedetails": {"001": {"index": "1.0", "style": "Arabic", "number": "1"}}}))
    docs = S.documents(spark, f"{tmp_path}/*.txt")
    assert {r["name"]: r["text"] for r in docs.collect()} == {"a.txt": "é one\ntwo", "b.txt": "é two"}
    got = {r["name"]: r for r in S.with_side_cars(docs, S.documents(spark, f"{tmp_path}/*.json")).collect()}
    assert got["a.txt"]["unchanged"] and got["a.txt"]["car"]["pagedetails"]["001"]["style"] == "Arabic" and got["b.txt"]["car"] is None


def test_pages(spark, tmp_path):
    for n, t in (("002", "second \n\n"), ("001", "first\nline")):
        (tmp_path / f"{n}.txt").write_text(t)
    book = S.pages_as_document(S.documents(spark, f"{tmp_path}/*.txt"))
    text = book.first()["text"]
    assert text == "-----File: 001.png-----\nfirst\nline\n-----File: 002.png-----\nsecond\n"
    pages = S.document_as_pages(book.withColumnRenamed("project", "name")).collect()
    assert sorted((r["page"], r["text"]) for r in pages) == [("001", "first\nline"), ("002", "second")]


def test_word_lists(spark, tmp_path):
    (tmp_path / "words.txt").write_text("b\n a \n\nb\n")
    assert sorted(r["word"] for r in S.lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["a", "b"]
    words = spark.createDataFrame([("x", "good"), ("y", "bad"), ("z", "good")], "word string, kind string")
    S.save_project_words(words, str(tmp_path / "project"))
    assert sorted(map(tuple, S.project_words(spark, str(tmp_path / "project")).collect())) == [("x", "good"), ("y", "bad"), ("z", "good")]
    (tmp_path / "phrases.txt").write_text("a|he|b:12\nto|be:3\nno number\n")
    assert sorted(map(tuple, S.phrases(spark, str(tmp_path / "phrases.txt")).collect())) == [("a he b", 12), ("to be", 3)]


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"wholeword": True, "scannos": [{"match": "tbe", "replacement": "the"}, {"match": "arid", "replacement": ["and", "arid"], "hint": "h"}]}))
    got = S.rules(spark, str(tmp_path / "r.json")).orderBy("ord").collect()
    assert [(r["match"], r["replacements"], r["hint"], r["whole"]) for r in got] == [("tbe", ["the"], "", True), ("arid", ["and", "arid"], "h", True)]


def test_scanner_pages(spark, tmp_path):
    line = lambda s: "<line b='1'>" + "".join(f"<charParams l='1'>{c}</charParams>" for c in s) + "</line>"
    xml = "<document><page w='1'>" + line(["A", "&amp;", " ", " ", "b"]) + line("c") + "</page><page>" + line("d") + "</page></document>"
    with gzip.open(tmp_path / "x.xml.gz", "wt") as f:
        f.write(xml)
    got = S.scanner_pages(spark, str(tmp_path / "x.xml.gz")).collect()
    assert sorted((r["page"], r["line_no"], r["line"]) for r in got) == [(0, 0, "A& b"), (0, 1, "c"), (1, 0, "d")]


def test_saved_texts(spark, tmp_path):
    S.save_texts(spark.createDataFrame([("a", "x\ny"), ("b", "z")], "name string, text string"), str(tmp_path / "out"))
    assert {r["name"]: r["value"] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()} == {"a": "x\ny\n", "b": "z\n"}
