"""License scans (1): canonical digests of entire texts, hash-joined to known licences.

Native: DataFrame expressions only.  A text is canonicalised (case, copyright
lines, equivalent spellings, punctuation and spacing) and its SHA-256 looked up
in a table of known digests.  Short notices stand inside ordinary documents, so
every line that names a licence is looked up as an entire text of its own too.

The known table (a parameter) holds a digest and a name a row.  Up to MAX_KNOWN
rows it is broadcast; beyond, the same joins shuffle.  Texts are never shuffled:
a document becomes one small row for each line that names a licence, these join
the known table, and one row a document (its digest, the names found) is put
together again.

Defined results: null, empty and blank texts, and texts of copyright lines
alone, have the digest of the empty string and match nothing; equal texts each
get their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.license_texts import DIGESTS, EQUIVALENT, KNOWN

#: Most rows of a known table that is broadcast (about 100 bytes each).
MAX_KNOWN = 10_000


def canonical(text: Column) -> Column:
    s = F.lower(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, r"(?m)^[ \t*#/-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$", "")
    for old, new in EQUIVALENT:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, license_id) of texts and of ready digests; of licences with equal canonical texts the first name wins."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "i int, license_id string, body string")
    ready = spark.createDataFrame([(len(known) + i, n, d) for i, (d, n) in enumerate(digests)], "i int, license_id string, digest string")
    rows = rows.select("i", "license_id", digest(F.col("body")).alias("digest")).unionByName(ready)
    return rows.groupBy("digest").agg(F.min_by("license_id", "i").alias("license_id"))


def license_scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the entire text, else null), notices (names of the
    licences that single lines state, sorted, joined by commas; '' if none) and matched.

    known has one row a digest."""
    known = (known if known is not None else known_licenses(spark)).select("digest", "license_id")
    if len(known.limit(MAX_KNOWN + 1).collect()) <= MAX_KNOWN:
        known = F.broadcast(known)
    body = F.coalesce(F.col("text"), F.lit(""))
    named = F.filter(F.split(body, "\n"), lambda x: x.rlike("(?i)licen[cs]e"))
    # numbered in a projection of its own: beside a generator, the lines would be numbered
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest(F.col("text")).alias("digest"), F.transform(named, digest).alias("lines"))
    rows = rows.select("rid", "doc_id", "digest", F.explode_outer("lines").alias("line"))
    notice = known.select(F.col("digest").alias("line"), F.col("license_id").alias("notice"))
    hits = rows.join(notice, "line", "left").groupBy("rid", "doc_id", "digest").agg(F.collect_set("notice").alias("names"))
    out = hits.join(known, "digest", "left").select("doc_id", "digest", "license_id", F.array_join(F.array_sort("names"), ",").alias("notices"))
    return out.withColumn("matched", F.col("license_id").isNotNull() | (F.col("notices") != ""))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    s = f"lower(coalesce({x}, ''))"
    s = f"regexp_replace({s}, '(?m)^[ \\t*#/-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g')"
    for old, new in EQUIVALENT:
        s = f"replace({s}, '{old}', '{new}')"
    return f"trim(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    rows = ",\n".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(KNOWN))
    ready = ",\n".join(f"({len(KNOWN) + i}, '{n}', '{d}')" for i, (d, n) in enumerate(DIGESTS))
    return f"""
WITH raw(i, license_id, body) AS (VALUES {rows}),
ready(i, license_id, digest) AS (VALUES {ready}),
known AS (
  SELECT digest, min_by(license_id, i) AS license_id
  FROM (SELECT i, license_id, sha256({_sql_canonical('body')}) AS digest FROM raw UNION ALL FROM ready) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (
  SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM l JOIN known ON sha256({_sql_canonical('line')}) = known.digest
  WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY rid)
SELECT d.doc_id, d.digest, k.license_id, coalesce(n.notices, '') AS notices,
       k.license_id IS NOT NULL OR n.notices IS NOT NULL AS matched
FROM d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN n ON d.rid = n.rid
"""
