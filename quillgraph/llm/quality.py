"""Quality rules (4): per-document rules, and host verdicts from shrunken failure rates.

Native: DataFrame expressions only.  The features of a text are computed inside
its row (no word leaves the row, so nothing is shuffled by word); only
(source, documents, failures) is aggregated, with map-side partial sums, so one
source with a third of all rows costs one partial row a task.

Defined results: a null or blank text has no words and fails the base rule; a
null source is a host of its own; repeated rows are judged each on its own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import WS_CLASS, let, materialize, table, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its shrunken failure rate reaches this; a few bad pages never condemn a host.
HOST_RATE = 0.75


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        order = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            order,
            lambda s: F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            ),
        )
        walk = F.aggregate(
            F.array_sort(twice),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"].cast("long"),
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(walk)

    grams = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return let(grams, covered)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs' columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    by_word = let(
        words_of(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat")),
    )
    lines = let(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]")),
        lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    )
    out = docs.withColumns(
        {
            "_by_word": by_word,
            "word_chars": F.length(F.regexp_replace(body, f"[{WS_CLASS}]++", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]++", "")).cast("long"),
            "n_dup_lines": lines,
        }
    )
    out = out.withColumns({"n_words": F.col("_by_word.n"), "n_repeat_words": F.col("_by_word.repeat")}).drop("_by_word")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """(source, host_failed): failure rates shrunk by a beta prior fitted to all hosts by moments."""
    hosts = judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad")
    )
    share = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(share).alias("m"), F.coalesce(F.var_samp(share), F.lit(0.0)).alias("v"))
    # m(1-m)/v - 1 pseudo-documents; equal rates leave no spread to learn from, so they count as many
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(
        F.lit(1000.0)
    )
    # one row of two numbers, read as a scalar subquery
    prior = prior.select(F.struct("m", F.least(strength, F.lit(1000.0)).alias("k"))).scalar()
    hosts = hosts.withColumn("_p", prior)
    shrunk = (F.col("bad") + F.col("_p.m") * F.col("_p.k")) / (F.col("n") + F.col("_p.k"))
    return hosts.select("source", (shrunk >= rate).alias("host_failed"))


def quality_rules(spark: SparkSession, docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """doc_id, source, the features, base_failed, host_failed and kept, one row a document."""
    judged = materialize(spark, features(docs.select("doc_id", "text", "source")).drop("text"), "quality")
    hosts = host_verdicts(judged, rate).withColumnRenamed("source", "_host")
    out = judged.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2),
covered AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (rid) LEFT JOIN lines l USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM b GROUP BY source),
p AS (SELECT avg(bad / n) AS m, coalesce(var_samp(bad / n), 0) AS v FROM h),
k AS (SELECT m, least(CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1000.0 END, 1000.0) AS k FROM p),
v AS (SELECT source, (bad + m * k) / (n + k) >= 0.75 AS host_failed FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
