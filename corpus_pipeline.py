"""Documents from raw to token digests: five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  Each row is a
document of its own, also where doc_ids repeat or are null: a stage numbers the rows in order of doc_id,
null last, then of hashes of text and source, and judges them by their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.bpe import round_trip
from quillgraph.llm.common import materialize, table
from quillgraph.llm.decontaminate import overlaps
from quillgraph.llm.minhash import near_duplicates
from quillgraph.llm.quality import quality_rules
from quillgraph.llm.suffix_dedup import dedup

#: Words of the near-dedup stage's shingles; op2 has its own.
SHINGLE = 5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, with the row's number instead of doc_id, which becomes _own.

    Where no doc_id is null or repeated it is the number itself, and texts are neither sorted nor written again."""
    rows = docs.select(F.col("doc_id").alias("_own"), *COLUMNS[1:])
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        return rows.withColumn("doc_id", F.col("_own").cast("long"))
    rows = rows.orderBy(F.col("_own").asc_nulls_last(), F.xxhash64("text", "source"))
    return materialize(spark, rows.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")


def _without(spark: SparkSession, docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that are not in ``find`` (doc_id) of the numbered rows, with the columns of documents."""
    rows = _numbered(spark, docs)
    gone = find(rows.drop("_own")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti")
    return rows.select(F.col("_own").alias("doc_id"), *COLUMNS[1:])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(spark, docs, lambda rows: quality_rules(spark, rows).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return _without(spark, docs, lambda rows: near_duplicates(spark, rows, SHINGLE).where("NOT kept"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that came earlier are cut out; a character of which a part is
    left goes with it, and n_chars is counted anew."""
    rows = _numbered(spark, docs)
    cut = dedup(spark, rows.drop("_own")).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("_id"), whole_characters(F.col("kept")).alias("_text"))
    out = rows.join(cut, rows["doc_id"] == cut["_id"], "left")
    text = F.when(F.col("_id").isNull(), F.col("text")).otherwise(F.col("_text"))
    n_chars = F.when(F.col("_id").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast("long"))
    return out.select(F.col("_own").alias("doc_id"), text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def whole_characters(body):
    """Text of UTF-8 bytes without the bytes that belong to no whole character."""
    # replacement characters of the text itself are written as other ones meanwhile
    mark, own, other = F.lit("\x01"), F.lit("\x01a"), F.lit("\x01b")
    text = F.replace(F.replace(body.cast("string"), mark, own), F.lit("�"), other)
    text = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.replace(F.replace(text, other, F.lit("�")), own, mark)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return _without(spark, docs, lambda rows: overlaps(spark, rows, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return round_trip(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]
#: Cutting bytes out of texts and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
