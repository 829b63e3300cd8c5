"""Incremental evaluation: files as versions, findings kept a file, only changed files judged again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each path: (path, generation, hash, ...); on ties the greatest hash.  Older
    generations that arrive late lose."""
    cols = [c for c in versions.columns if c != "path"]
    best = F.max_by(F.struct(*cols), F.struct("generation", "hash")).alias("v")
    return versions.groupBy("path").agg(best).select("path", *[F.col(f"v.{c}").alias(c) for c in cols])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed between two (path, hash) states."""
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    both = a.join(b, "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select("path", kind.alias("change"))


def merge_edges(old: DataFrame, fresh: DataFrame, scope: DataFrame, nodes: DataFrame, keys: tuple = ("file", "function")) -> DataFrame:
    """Old rows outside the scope and fresh ones inside it, without edges whose ends are gone."""
    inside = scope.select(*keys).distinct()
    out = old.join(inside, list(keys), "left_anti").unionByName(fresh.join(inside, list(keys), "left_semi"))
    ends = nodes.select("file", "id")
    for end in ("src", "dst"):
        out = out.join(ends.withColumnRenamed("id", end), ["file", end], "left_semi")
    return out


def dirty_callers(calls: DataFrame, changed: DataFrame, spark: SparkSession) -> DataFrame:
    """(fn): the changed functions and everything that calls them, however far."""
    from quillgraph.operators.closure import reach

    edges = calls.select(F.lit(0).alias("k"), F.col("callee").alias("src"), F.col("caller").alias("dst"))
    seeds = changed.select(F.lit(0).alias("k"), F.col("fn").alias("seed"))
    return reach(spark, seeds, edges, ["k"]).select(F.col("node").alias("fn")).distinct()


class IncrementalScan:
    """Keeps state and findings as Parquet and, for every micro-batch of (path, generation, hash, ...) rows,
    evaluates only the paths whose hash changed.  A row with a null hash removes its path.

    ``evaluate`` maps the rows of the changed files to findings with a ``file`` column.  Each batch writes a
    new version of both tables before the pointer moves, so a batch that fails midway is repeated whole.  The
    pointer is a table in the same folder, (sequence, version): a scan that starts again on the folder goes
    on from it.  ``rules`` is a signature of the rule set: a path that another set has judged is judged anew when
    it next comes, changed or not."""

    def __init__(self, spark: SparkSession, path: str, evaluate: Callable[[DataFrame], DataFrame], rules: str = ""):
        self.spark, self.path, self.evaluate, self.rules = spark, path.rstrip("/"), evaluate, rules
        self.sequence, self.version = 0, None
        if self._exists(f"{self.path}/pointer"):
            last = spark.read.parquet(f"{self.path}/pointer").agg(F.max(F.struct("sequence", "version")).alias("p")).first()["p"]
            if last is not None:
                self.sequence, self.version = last["sequence"], last["version"]

    def _exists(self, path: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(f"{self.path}/{name}/v={self.version}")

    def batch(self, rows: DataFrame, number: int) -> None:
        rows = latest(rows)
        state, findings = self._read("state"), self._read("findings")
        if state is not None:
            same_rules = F.col("rules").eqNullSafe(F.lit(self.rules))
            known = state.select("path", F.col("generation").alias("_g"), F.col("hash").alias("_h"), same_rules.alias("_same"))
            rows = rows.join(known, "path", "left").where("_g IS NULL OR generation >= _g")
            rows = rows.where(~(F.col("hash").eqNullSafe(F.col("_h")) & (F.col("hash").isNull() | F.coalesce("_same", F.lit(False))))).drop("_g", "_h", "_same")
        touched = rows.select("path")
        fresh = self.evaluate(rows.where("hash IS NOT NULL"))
        now = rows.where("hash IS NOT NULL").select("path", "generation", "hash", F.lit(self.rules).alias("rules"))
        if state is not None:
            now = state.join(touched, "path", "left_anti").unionByName(now)
            gone = touched.withColumnRenamed("path", "file")
            fresh = findings.join(gone, "file", "left_anti").unionByName(fresh)
        version = f"{self.sequence + 1}-{number}-{uuid.uuid4().hex[:8]}"
        now.write.parquet(f"{self.path}/state/v={version}")
        fresh.write.parquet(f"{self.path}/findings/v={version}")
        pointer = self.spark.createDataFrame([(self.sequence + 1, version)], "sequence long, version string")
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        self.sequence, self.version = self.sequence + 1, version

    def start(self, stream: DataFrame, checkpoint: str):
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def findings(self) -> DataFrame | None:
        return self._read("findings")
