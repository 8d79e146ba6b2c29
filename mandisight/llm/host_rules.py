"""Operator 4: host-level quality rules (DataFrame functions only).

Every document is measured from its whole text; the base rule fails short
documents and those mostly made of repeated three-word windows. Failures are
added up by host (``source``), one row per host and task before the shuffle.
A host's failure rate is shrunk towards the corpus with a beta prior whose
two parameters come from the hosts themselves (method of moments), so a host
of a few documents is judged by the corpus and a large one by itself. Hosts
whose shrunk rate is above ``max_rate`` are rejected, and the verdict is
joined back to the documents.

Defined results: a null or empty text has no words, so it fails the base
rule; documents of a null host have no host verdict and are judged by the
base rule alone; one host, or hosts without spread, give a prior of
``strength`` documents at the corpus rate; repeated rows count as rows; an
empty table gives no rows; extra columns are carried on by ``judge``, but for
those with the name of a result column, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mandisight.llm.common import ASCII_SPACE, table, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Hosts with a larger shrunk failure rate are rejected.
MAX_HOST_RATE = 0.6
#: Documents that the prior weighs where the hosts show no spread of their own.
PRIOR_STRENGTH = 20.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters."""
    return F.array_remove(F.split(F.translate(text, ASCII_SPACE, " " * len(ASCII_SPACE)), " "), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the five measures and base_failed; other columns unchanged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, ASCII_SPACE, "")
    # A line has a word if anything is left of it without white space.
    lines = F.filter(F.split(text, "\n"), lambda s: F.translate(s, ASCII_SPACE, "") != "")
    hashes, ordered, places = (free_name(docs, n) for n in ("_hashes", "_sorted", "_places"))
    df = docs.withColumn(hashes, F.transform(words_of(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size(hashes).cast("long"))
    # (hash of the window, place): equal windows are neighbours once sorted.
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"),
                           i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn(ordered, F.sort_array(windows))
    df = df.withColumn(places, F.sort_array(F.transform(
        F.filter(ordered, lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False))), lambda x: x["i"])))
    # Each repeated window covers three words, less what the next one covers too.
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    df = df.withColumns({
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop(hashes, ordered, places)


def host_rates(marked: DataFrame, host: str = "source", strength: float = PRIOR_STRENGTH) -> DataFrame:
    """host, host_docs, host_failed and the shrunk rate; ``marked`` has host and base_failed."""
    hosts = (marked.where(F.col(host).isNotNull()).groupBy(host)
             .agg(F.count(F.lit(1)).alias("host_docs"),
                  F.sum(F.col("base_failed").cast("long")).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    # The moments over all hosts are one row; var_samp is null for a single host.
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("noise"),
                  (F.sum("host_failed") / F.sum("host_docs")).alias("rate")).first()
    weight = strength
    if m["mean"] is not None and 0 < m["mean"] < 1:
        # Spread beyond what the binomial noise of the host sizes explains.
        between = (m["var"] or 0.0) - m["mean"] * (1 - m["mean"]) * m["noise"]
        if between > 0:
            weight = max(1.0, m["mean"] * (1 - m["mean"]) / between - 1)
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(weight * (m["rate"] or 0.0)))
                            / (F.col("host_docs") + F.lit(weight)))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE,
          strength: float = PRIOR_STRENGTH, keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures, base_failed, host counts and kept."""
    names = ["base_failed", "kept", "host_docs", "host_failed", "host_rate", *MEASURES]
    marked = measured(docs.drop(*names))
    # Measured once, then read for the host counts and for the verdicts.
    marked = written(marked if keep_text else marked.drop("text"), "measured")
    # As a written table the hosts have a known size: while it is small it is broadcast, and the documents are not
    # shuffled by host at all.
    rates = written(host_rates(marked, host, strength), "hosts")
    verdict = F.col("base_failed") | F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return marked.join(rates, host, "left").withColumn("kept", ~verdict)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return judge(docs, keep_text=False).select("doc_id", *MEASURES, "base_failed", "kept", "host_docs", "host_failed")


SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base),
word AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM tokens),
win AS (
  SELECT rid, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c
  FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)),
dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL)
  WHERE n > 1),
cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM base),
lines AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM line
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base JOIN tokens USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
marked AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
host AS (
  SELECT source, count(*) AS host_docs, sum(CAST(base_failed AS BIGINT)) AS host_failed
  FROM marked WHERE source IS NOT NULL GROUP BY source),
moments AS (
  SELECT avg(host_failed / host_docs) AS mu, coalesce(var_samp(host_failed / host_docs), 0) AS v,
    avg(1.0 / host_docs) AS noise, sum(host_failed) / sum(host_docs) AS rate FROM host),
prior AS (
  SELECT rate, CASE WHEN v - mu * (1 - mu) * noise > 0 AND mu > 0 AND mu < 1
    THEN greatest(1.0, mu * (1 - mu) / (v - mu * (1 - mu) * noise) - 1) ELSE 20.0 END AS weight FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce((host_failed + weight * rate) / (host_docs + weight) > 0.6, FALSE)) AS kept,
  host_docs, CAST(host_failed AS BIGINT) AS host_failed
FROM marked LEFT JOIN (host CROSS JOIN prior) USING (source)
"""
