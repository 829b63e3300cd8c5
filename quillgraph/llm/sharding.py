"""Sharding (9): balanced label propagation under capacity quotas; the law is ``rows``.

Documents of equal text are linked (each to its group, a star).  Linked
documents start at the shard their own hash gives.  In each round a Spark join
gives every unsettled linked document the label most frequent among its group's
unsettled members, among the shards that still have room; those who rank within
the shard's remaining quota settle there, so the largest groups go first and a
group over a shard's quota is continued in the next round in one other shard.
Whoever is left, and all unlinked documents, then fill the quotas exactly:
counts are at most one apart.

Ranks are never taken in one task: rows are range-partitioned by the whole order
(the document included, so a group with a third of all rows is split too),
numbered inside partitions, and offset by the counts of earlier partitions.
Only the 16 counts of shards reach the driver.

Defined results: a null text has size 1, the CRC of the empty string and belongs
with the empty texts; repeated doc_ids keep a row each; fewer documents than
shards leave the last shards empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import documents, materialize, shuffle_partitions, table

SHARDS = 16
ROUNDS = 3


def ranked(spark: SparkSession, df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``rank``, gapless from 0 in the order within each value of ``by`` (few values)."""
    keys = [F.col(c) for c in by] + order
    laid = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = materialize(spark, laid.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # partitions times values of ``by`` rows
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    laid = laid.withColumn("_part", part).join(counts, [*by, "_part"])
    return laid.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_part")


def _settle(spark: SparkSession, left: DataFrame, room: list[int], turn: int) -> DataFrame:
    """One round: columns of ``left`` with to (its group's shard) and rank within it."""
    space = F.array(*[F.lit(x) for x in room])
    by_label = left.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = F.get(space, F.col("label")) > 0
    hub = by_label.groupBy("g").agg(
        F.sum("n").alias("g_rows"),
        F.max_by("label", F.when(open_, F.struct("n", (-F.col("label")).alias("l")))).alias("to"),
    )
    # a group none of whose members stands in an open shard goes to one of them by its hash
    ways = [s for s, x in enumerate(room) if x > 0] or [0]
    spare = F.get(F.array(*[F.lit(s) for s in ways]), F.pmod(F.xxhash64("g"), F.lit(len(ways))).cast("int"))
    hub = hub.withColumn("to", F.coalesce("to", spare))
    order = [F.col("g_rows").desc(), F.col("g"), F.col("doc_id"), F.col("u")]
    return ranked(spark, left.join(hub, "g"), ["to"], order, f"shards-{turn}")


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("g"),
    )
    base = materialize(spark, base.withColumn("u", F.monotonically_increasing_id()), "shard-base")
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("g")
    linked = materialize(
        spark,
        base.select("g", "doc_id", "u").join(groups, "g", "left_semi").withColumn(
            "label", F.pmod(F.xxhash64("doc_id", "u"), F.lit(shards)).cast("int")
        ),
        "shard-linked",
    )
    total = base.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    settled, left = None, linked
    for turn in range(ROUNDS):
        placed = _settle(spark, left, room, turn)
        fits = F.col("rank") < F.get(F.array(*[F.lit(x) for x in room]), F.col("to"))
        done = placed.where(fits).select("u", F.col("to").alias("shard"))
        left = materialize(spark, placed.where(~fits).select("g", "doc_id", "u", "label"), f"shard-left-{turn}")
        settled = done if settled is None else settled.unionByName(done)
        counts = {r["shard"]: r["n"] for r in done.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [x - counts.get(s, 0) for s, x in enumerate(room)]
        if not any(room):
            break
    rest = base.select("doc_id", "u", "g").join(settled.select("u"), "u", "left_anti")
    rest = ranked(spark, rest.withColumn("_all", F.lit(0)), ["_all"], [F.col("g"), F.col("doc_id"), F.col("u")], "shard-rest")
    ends, end = [], 0
    for x in room:
        end += x
        ends.append(end)
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank")))
    settled = settled.unionByName(rest.select("u", to.alias("shard")))
    placed = base.drop("g").join(settled, "u")
    out = ranked(spark, placed, ["shard"], [F.col("doc_id"), F.col("u")], "shard-slots")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))
