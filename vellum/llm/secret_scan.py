"""Secret scans: patterns, and a randomness test battery with length-aware false-discovery control.

Everything is a DataFrame expression inside the document's row. Patterns: a text split at the matches and the matches themselves give every start and end.
Battery: each run of 20 or more letters of base64 gets an inferred encoding (hex, base32, one-case letters, base62, base64) and, for it, three p-values under
"its symbols are independent and uniform": chi-squared over the alphabet, runs about the alphabet's middle, and lag-1 serial correlation. Fisher's method combines them.
Random strings have uniform combined p-values, words have p-values near 0. So in each stratum of encoding and length the number of random strings is twice the count over
one half, and of those at or over a cut the part beyond their share is false. The lowest cut (in hundredths) at which that part is at most FDR
decides in its stratum; a stratum without such a cut gives no span. The histogram of p-values over all documents has a bounded number of cells, and it alone comes to the driver.

Null text is empty: no spans, and the digest of the empty string. Repeated rows are scanned one by one. An empty table gives an empty result.
Spans count in code points; their ends are exclusive.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table
from vellum.session import written

_WORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
#: Kind, pattern, group whose length counts, least length. Only failing matches are dropped, after the search.
KINDS = [
    ("assign", rf"""({_WORDS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
#: Does a text hold a match that is long enough? Spares most texts the search for all matches.
_MAYBE = {"assign": KINDS[0][1][:-1] + "{5,})", "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
METHOD = "random"
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order of inference: name, pattern, alphabet in order of value; letters' case is dropped for one-case encodings.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("alpha", "^([A-Z]?[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
#: Lower ends of the length strata.
STRATA = (20, 24, 32, 48, 80)
FDR, CELLS = 0.05, 100


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>> of a kind's matches."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.transform(F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("p"), hits.alias("h"), sizes.alias("g")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["h"]).alias("h"), F.length(x["g"]).alias("g")))
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["p"] + x["h"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["p"]).alias("start"), (a["at"] + x["p"] + x["h"]).alias("end"), x["g"].alias("size")))).alias("out")),
    )["out"]
    kept = F.transform(F.filter(walked, lambda x: x["size"] >= least), lambda x: F.struct(x["start"], x["end"]))
    return F.when(text.rlike(_MAYBE.get(kind, pattern)), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _below(z: Column) -> Column:
    """The normal distribution function by its logistic approximation (within 0.0002)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _battery(tokens: Column) -> Column:
    """array<struct<start, end, enc, stratum, p>> of array<struct<start, end, token>>. Each step is a lambda of its own, so what it makes is computed once."""
    letters = F.array(*(F.lit(a) for _, _, a in ENCODINGS))

    def inferred(x: Column) -> Column:
        body = F.translate(F.rtrim(x["token"], F.lit("=")), "-_", "+/")
        enc: Column = F.lit(len(ENCODINGS) - 1)
        for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            enc = F.when(body.rlike(pattern), i).otherwise(enc)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), enc.alias("enc"), body.alias("body"))

    def counted(x: Column) -> Column:
        alphabet, body = F.get(letters, x["enc"]), F.when(x["enc"] <= 2, F.lower(x["body"])).otherwise(x["body"])
        values = F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), F.length(alphabet).cast("double").alias("a"), values.alias("v"))

    def tested(x: Column) -> Column:
        middle, n, k = (x["a"] - 1) / 2, F.size(x["v"]).cast("double"), x["a"] - 1
        squares = F.aggregate(F.array_distinct(x["v"]), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(x["v"], lambda y: y == c)).cast("double"), 2))
        pairs = F.zip_with(F.slice(x["v"], 1, F.size(x["v"]) - 1), F.slice(x["v"], 2, F.size(x["v"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + F.when((q["a"] > middle) != (q["b"] > middle), 1.0).otherwise(0.0))
        lag = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["a"] - middle) * (q["b"] - middle))
        chi = F.greatest(x["a"] / n * squares - n, F.lit(0.0))
        cube = (F.pow(chi / k, 1 / 3) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = lag / ((x["a"] * x["a"] - 1) / 12) / F.sqrt(n - 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), cube.alias("cube"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"))

    def combined(x: Column) -> Column:
        """Minus the sum of the logarithms of the p-values."""
        logs = [F.log(F.greatest(F.lit(1e-12), p)) for p in (1 - _below(x["cube"]), 2 * _below(-x["runs"]), 2 * _below(-x["serial"]))]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), (-(logs[0] + logs[1] + logs[2])).alias("half"))

    def judged(x: Column) -> Column:
        """Fisher's statistic is chi-squared with six degrees of freedom."""
        length = x["end"] - x["start"]
        stratum = sum((F.when(length >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(0))
        p = F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"), stratum.alias("stratum"), p.alias("p"))

    for step in (inferred, counted, tested, combined, judged):
        tokens = F.transform(tokens, step)
    return tokens


def scanned(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns, base (array<struct<start, rank, kind, end>>) and candidates (array<struct<start, end, enc, stratum, p>>) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*keep, body.alias("_body"), *(_matches(body, *k).alias(f"_{k[0]}") for k in KINDS), _matches(body, METHOD, TOKEN, 0, 0).alias("_tokens"))

    def named(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    base = F.concat(*(named(i, k[0]) for i, k in enumerate(KINDS)))

    tokens = F.transform("_tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(F.col("_body"), x["start"] + 1, x["end"] - x["start"]).alias("token")))
    return found.select(*keep, F.array_sort(base).alias("base"), _battery(tokens).alias("candidates"))


def cuts(scans: DataFrame) -> list[tuple[int, int, float]]:
    """(encoding, stratum, least p) of the strata that give spans, from the p-values of all rows. At most 5 x 5 x 100 cells come to the driver."""
    one = scans.select(F.explode("candidates").alias("c"))
    cell = F.least(F.floor(F.col("c.p") * CELLS), F.lit(CELLS - 1)).cast("int")
    cells: dict[tuple[int, int], list[int]] = {}
    for r in one.groupBy(F.col("c.enc").alias("enc"), F.col("c.stratum").alias("stratum"), cell.alias("cell")).count().collect():
        cells.setdefault((r["enc"], r["stratum"]), [0] * CELLS)[r["cell"]] = r["count"]
    out = []
    for (enc, stratum), counts in sorted(cells.items()):
        random = 2 * sum(counts[CELLS // 2 :])
        for k in range(1, CELLS):
            over = sum(counts[k:])
            if over and max(0.0, over - random * (1 - k / CELLS)) <= FDR * over:
                out.append((enc, stratum, k / CELLS))
                break
    return out


def _chosen(limits: list[tuple[int, int, float]]) -> Column:
    """base with the spans of the candidates that pass."""

    def passes(c: Column) -> Column:
        test = F.lit(False)
        for enc, stratum, p in limits:
            test = test | ((c["enc"] == enc) & (c["stratum"] == stratum) & (c["p"] >= p))
        return test

    more = F.transform(F.filter("candidates", passes), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(METHOD).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat("base", more))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each row of documents. Only the scans, without texts, are written in between."""
    scans = written(scanned(docs, "text", ("doc_id",)), "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k[0]) for k in KINDS]
    rows = scans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), F.size("base").alias("_n"), _chosen(cuts(scans)).alias("_all"))
    return rows.select("doc_id", *(f"n_{k[0]}" for k in KINDS), "base_sha256", _joined(F.col("_all")).alias("spans"), (F.size("_all") - F.col("_n")).cast("long").alias("n_random"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of documents with each stretch of touching or overlapping spans replaced by mask; n_chars follows where the text changed."""
    limits = cuts(written(scanned(docs, "text", ()).select("candidates"), "candidates"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    rows = scanned(whole, "_text", ("_row", "_text")).select("_row", "_text", _chosen(limits).alias("_all"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        new = (x["start"] > a["at"]) | (a["out"] == "")
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(new, F.concat(a["out"], gap, F.lit(mask))).otherwise(a["out"]).alias("out"))

    end = F.aggregate("_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rows = rows.select("_row", "_text", (F.size("_all") > 0).alias("_hit"), end.alias("_end"))
    rows = rows.select("_row", "_hit", F.when(F.col("_hit"), F.concat(F.col("_end.out"), F.substring("_text", F.col("_end.at") + 1, F.length("_text")))).otherwise(F.col("_text")).alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_hit"), F.length("_new")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return rows.select(*(new.get(f.name, F.col("_row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))

