"""Quality rules with host-level verdicts.

Rules of each document are DataFrame expressions inside the row, so texts never move. A rule compares a share (as symbols to a word) with a limit. Failures are summed by host, for each rule and for all of them together; each
host's failure rates are shrunk towards empirical beta priors fitted to all hosts, and held against the corpus's rates. The worse of a rule's own ratio and that of all rules is the host's verdict on it: a host at or above the corpus's
rate gets no slack, one without failures up to all of it, which doubles the limit, and what lies between in proportion. Documents go that pass the limit with their host's slack, so junk on ordinary hosts goes, strong junk goes
on the best of hosts, and mild cases stay where a host is known to be clean. Rules of the base (base_failed) reject by themselves. A document that fails no rule is kept whatever its host is.

Null text has no words and so fails. A null host is a host of its own. Repeated rows are judged one by one. A very long text is one row like others. Columns of any other name are carried through or ignored. An empty table gives an empty result.
Windows are compared by their 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table
from vellum.session import written

#: Bounds of the priors' strength, in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0
#: The rules that act through the host's verdict: a document fails where the first feature is over the second times the limit, a fraction.
RULES = {
    "symbols": ("n_symbols", "n_words", 3, 10),
    "duplicate_lines": ("n_dup_lines", "n_lines", 2, 5),
    "short_words": ("n_words", "word_chars", 1, 3),
    "long_words": ("word_chars", "n_words", 10, 1),
}
#: Thousandths of a limit that are the greatest slack.
SLACK = 1000
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Most hosts with slack that are broadcast; with more the documents are joined by host, hot hosts dealt over SALTS parts.
BROADCAST_HOSTS, SALTS = 100_000, 64

_BLANK = "[ \\t-\\r]+"


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    split = df.select(*keep, F.filter(F.split(body, _BLANK), lambda x: x != "").alias("_words"), (F.length(body) - bare).alias("n_symbols"), lines.alias("_lines"))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    hashed = split.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(n >= 4, F.sort_array(windows)).alias("_windows"),
    )
    m = F.size("_windows")
    pairs = F.zip_with(F.slice("_windows", 1, m - 1), F.slice("_windows", 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    return hashed.withColumn("n_repeat_words", F.when(F.col("_windows").isNull(), 0).otherwise(covered).cast("long")).drop("_windows")


def base_failed() -> Column:
    return F.expr(BASE)


def _over(rule: str, slack: str = "0") -> str:
    """SQL of the condition that a document is over a rule's limit with so many thousandths of slack, in whole numbers."""
    x, y, n, d = RULES[rule]
    return f"{1000 * d} * {x} > {n} * (1000 + {slack}) * {y}"


_ANY = " OR ".join(_over(r) for r in RULES)


def host_verdicts(facts: DataFrame, host: str) -> DataFrame:
    """Each host's documents, shrunk failure rates, of all rules together too, and slacks in thousandths of the limits: host, n, rate_<rule>, rate_all, slack_<rule>.

    facts has a row per document with the rules' columns. Sums are combined before the shuffle, so a hot host is as good as any. The priors are two sums over the
    hosts and come back to the driver as one row.
    """
    tests = {**{r: _over(r) for r in RULES}, "all": _ANY}
    hosts = written(facts.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(F.expr(f"CAST(({x}) AS INT)")).alias(f"fail_{r}") for r, x in tests.items())), "hosts")
    total = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), *(F.sum(f"fail_{r}").alias(r) for r in tests)).first()
    mean = {r: total[r] / total["n"] if total["n"] else 0.0 for r in tests}
    spread = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(f"fail_{r}") / F.col("n") - m, 2)).alias(r) for r, m in mean.items())).first()
    rates = {}
    for r, m in mean.items():
        # Between-host variance by the method of moments: what the binomial doesn't explain.
        own = spread[r] / total["n"] - m * (1 - m) * total["h"] / total["n"] if total["n"] else 0
        strength = min(PRIOR_MOST, max(PRIOR_LEAST, m * (1 - m) / own - 1 if own > 0 else PRIOR_MOST))
        rates[r] = (F.col(f"fail_{r}") + m * strength) / (F.col("n") + strength)

    def slack(r: str) -> Column:
        worse = F.greatest(*(rates[x] / mean[x] for x in (r, "all") if mean[x]), F.lit(0.0), F.lit(0.0))
        return F.greatest(F.lit(0), F.round(SLACK * (1 - worse))).cast("long").alias(f"slack_{r}")

    return hosts.select("host", "n", *(x.alias(f"rate_{r}") for r, x in rates.items()), *(slack(r) for r in RULES))


def with_verdicts(df: DataFrame, verdicts: DataFrame, host: str, key: str) -> DataFrame:
    """df with the slack_<rule> columns of its rows' hosts; key spreads the rows of a hot host."""
    names = [f"slack_{r}" for r in RULES]
    some = verdicts.filter(" OR ".join(f"{x} > 0" for x in names)).select(F.col("host").alias("_host"), *names)
    if some.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = df.join(F.broadcast(some), df[host].eqNullSafe(F.col("_host")), "left").drop("_host")
    else:
        salted = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left[host].eqNullSafe(salted["_host"]) & (left["_part"] == salted["_salt"]), "left").drop("_host", "_salt", "_part")
    return joined.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in names})


VERDICT = f"NOT ({BASE}) AND NOT ({' OR '.join(_over(r, f'slack_{r}') for r in RULES)})"


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule_failed (some rule's plain limit is passed) and the host's slacks of each row of documents (doc_id, text, source)."""
    facts = written(features(docs, keep=("doc_id", "source")), "facts")
    rows = with_verdicts(facts, host_verdicts(facts, "source"), "source", "doc_id")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.expr(VERDICT).alias("kept"), F.expr(_ANY).alias("rule_failed"), *(f"slack_{r}" for r in RULES)
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay, whole. The texts are read twice rather than written once: first for the hosts, then for the rows; written rows need more of an executor's memory than there is."""
    facts = written(features(docs, keep=("source",)), "facts")
    whole = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"))
    # The number keeps the optimizer from moving the filter below the features, where it would repeat their expressions.
    rows = features(whole, "_text", ("_row", "_source", "_id")).withColumn("_number", F.monotonically_increasing_id())
    return with_verdicts(rows, host_verdicts(facts, "source"), "_source", "_id").filter(F.expr(VERDICT) & (F.col("_number") >= 0)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


_TESTS = {**{r: _over(r) for r in RULES}, "all": _ANY}


def _own(r: str) -> str:
    return f"(v_{r} / n_all - m_{r} * (1 - m_{r}) * h_all / n_all)"


def _slack(r: str) -> str:
    worse = ", ".join(f"coalesce(rate_{x} / nullif(m_{x}, 0), 0)" for x in (r, "all"))
    return f"CAST(greatest(0, round({SLACK} * (1 - greatest({worse})))) AS BIGINT) AS slack_{r}"


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM d)),
tri AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, c, count(*) OVER (PARTITION BY doc_id, word, b, c) AS k FROM tri) WHERE c IS NOT NULL AND k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS k FROM dup, (VALUES (0), (1), (2)) t(j) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY doc_id),
f AS (SELECT doc_id, source, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(ln.n, 0)::BIGINT AS n_lines, coalesce(ln.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.k, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
h AS (SELECT source AS host, count(*) AS n, {", ".join(f"sum(CAST(({x}) AS INT)) AS fail_{r}" for r, x in _TESTS.items())} FROM f GROUP BY source),
t AS (SELECT count(*) AS h_all, sum(n) AS n_all, {", ".join(f"sum(fail_{r}) / sum(n) AS m_{r}" for r in _TESTS)} FROM h),
v AS (SELECT {", ".join(f"sum(n * pow(fail_{r} / n - m_{r}, 2)) AS v_{r}" for r in _TESTS)} FROM h, t),
p AS (SELECT *, {", ".join(f"least({PRIOR_MOST}, greatest({PRIOR_LEAST}, CASE WHEN {_own(r)} > 0 THEN m_{r} * (1 - m_{r}) / {_own(r)} - 1 ELSE {PRIOR_MOST} END)) AS s_{r}" for r in _TESTS)} FROM t, v),
b AS (SELECT *, {", ".join(f"(fail_{r} + m_{r} * s_{r}) / (n + s_{r}) AS rate_{r}" for r in _TESTS)} FROM h, p),
k AS (SELECT host, {", ".join(map(_slack, RULES))} FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, ({VERDICT}) AS kept, ({_ANY}) AS rule_failed, {", ".join(f"slack_{r}" for r in RULES)}
FROM f JOIN k ON source IS NOT DISTINCT FROM host
"""
