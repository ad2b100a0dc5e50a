"""Capitals and small letters: every character, and queries over texts with letters whose case Spark's own functions see otherwise, against the SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum import registry
from vellum.plans.dialect import DUCK, SPARK


def test_every_character(spark):
    chars = [(c, chr(c)) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    t = pa.table({"c": [c for c, _ in chars], "x": [x for _, x in chars]})
    want = {c: rest for c, *rest in duckdb.from_arrow(t).query("t", f"SELECT c, {DUCK.upper('x')}, {DUCK.lower('x')} FROM t").fetchall()}
    got = {r[0]: [r[1], r[2]] for r in spark.createDataFrame(chars, "c int, x string").selectExpr("c", SPARK.upper("x"), SPARK.lower("x")).collect()}
    assert [(c, got[c], want[c]) for c in want if got[c] != want[c]] == []


@pytest.mark.parametrize("name", ["sentence_case", "title_case", "character_suites"])
def test_queries(spark, tmp_path, name):
    lines = ["ßer ΟΔΟΣ ΑΣ. İstanbul", "ﬁn ŉ", "ὈΔΟΣ ᾳ", "ǆ Ǆ ǅ", "\U00010d70 \U00010d50", "", "éa ÉA"]
    docs = [(1, "\n".join(lines)), *((i + 2, x) for i, x in enumerate(lines)), (90, None)]
    pq.write_table(pa.table({"doc_id": [i for i, _ in docs], "text": [x for _, x in docs]}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df = registry.queries()[name](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()[name]).to_arrow_table().select(df.columns).to_pylist()
    assert sorted((r.asDict() for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_suggestions(spark, tmp_path):
    """A lexicon word whose first letter has no capital of one letter in Spark."""
    docs = [f"ßchen ﬁnde {'Schen Pachen Finde Xchen' if i == 7 else ''}" for i in range(25)]
    pq.write_table(pa.table({"doc_id": list(range(25)), "text": docs}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df = registry.queries()["suggestions"](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["suggestions"]).to_arrow_table().select(df.columns).to_pylist()
    got = [r.asDict() for r in df.collect()]
    assert any(r["suggestion"] == "ẞchen" for r in got)
    assert sorted(got, key=repr) == sorted(want, key=repr)
