"""Measures of runs: stages, caches, counters, parallel stages and threads, and their reports.

Raw measures are rows, as many as there are; each summary is one aggregation.  Summaries have a row a name, so the
reports are put together on the driver; more than MOST names of a kind are an error, not cut off."""

from __future__ import annotations

import html
import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.analyses import histogram, hit_rate

#: Most names of a summary in a report.
MOST = 10_000


class Stages:
    """Times named stages on the driver; ``rows`` has (name, at, nanos) of every one that has ended, failed ones too."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows, self._begun = spark, [], time.perf_counter()

    @contextmanager
    def stage(self, name: str):
        begin = time.perf_counter_ns()
        try:
            yield
        finally:
            self._rows.append((name, len(self._rows), time.perf_counter_ns() - begin))

    @property
    def elapsed(self) -> float:
        return time.perf_counter() - self._begun

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, "name string, at long, nanos long")


def stages(samples: DataFrame) -> DataFrame:
    """A row a stage of (name, at, nanos) samples: count, total (mean times count), mean, percentiles, extremes, deviation."""
    h = histogram(samples, ["name"], "nanos", ["at"])
    return h.select("name", F.col("n").alias("count"), (F.col("mean") * F.col("n")).alias("total"), "mean", "p50", "p95", "p99", "min", "max", "stddev")


def caches(events: DataFrame) -> DataFrame:
    """A row a cache of (name, hits, misses, inserts, evictions, bytes) events; bytes is the greatest amount held."""
    out = events.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "inserts", "evictions")], F.max("bytes").alias("bytes"))
    return out.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.sum("value").alias("value"))


def parallel(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """(label, workers, wall, cpu, efficiency): plan names a label's wall and cpu stages; efficiency is the share of
    wall time times workers in percent, 100 at most and 0 where no time was measured."""
    total = lambda of: measured.select(F.col("name").alias(f"{of}_stage"), F.col("total").alias(of))
    out = plan.join(total("wall"), "wall_stage", "left").join(total("cpu"), "cpu_stage", "left").fillna(0, ["wall", "cpu"])
    most = F.col("wall") * F.col("workers")
    share = F.when(most > 0, F.least(F.lit(100.0), F.col("cpu") / most * 100)).otherwise(F.lit(0.0))
    return out.select("label", "workers", "wall", "cpu", share.alias("efficiency"))


def threads(tasks: DataFrame, pool: int) -> DataFrame:
    """One row of (worker, begin, end) tasks, end null while they run: pool, started (workers), submitted, completed,
    peak in flight (an end frees its place before a begin at the same time) and mean utilisation in percent.

    The peak is a running sum over beginnings and ends.  It is made in two steps, over ranges of time and inside
    them, so no task holds all events."""
    from pyspark.sql import Window

    events = tasks.select(F.explode(F.array(F.struct(F.col("begin").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("e.*").where("t IS NOT NULL")
    sums = events.groupBy("t").agg(F.sum("d").alias("net"))
    bounds = sums.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    lo, wide = (0, 1) if bounds["lo"] is None else (bounds["lo"], max(1, (bounds["hi"] - bounds["lo"]) // 4096 + 1))
    sums = sums.withColumn("slice", F.floor((F.col("t") - lo) / wide))
    # at most 4097 slices, one row each: the window without a partition is bounded
    before = sums.groupBy("slice").agg(F.sum("net").alias("net"))
    before = before.select("slice", (F.sum("net").over(Window.orderBy("slice")) - F.col("net")).alias("carried"))
    inside = F.sum("net").over(Window.partitionBy("slice").orderBy("t"))
    peak = sums.withColumn("in", inside).join(F.broadcast(before), "slice").agg(F.max(F.col("in") + F.col("carried")).alias("peak")).first()["peak"]
    span = F.max("end") - F.min("begin")
    whole = tasks.agg(F.countDistinct("worker").alias("started"), F.count("begin").alias("submitted"), F.count("end").alias("completed"),
        F.coalesce(F.when(span > 0, F.least(F.lit(100.0), F.sum(F.col("end") - F.col("begin")) * 100.0 / (span * pool))), F.lit(0.0)).alias("utilisation"))
    return whole.select(F.lit(pool).alias("pool"), "started", "submitted", "completed", F.lit(peak or 0).cast("long").alias("peak"), "utilisation")


def snapshot(elapsed: float, **summaries: DataFrame) -> dict:
    """The rows of summaries as plain values, stages by falling total, others by their first column."""
    out: dict = {"elapsed": elapsed}
    for name, df in summaries.items():
        rows = [r.asDict() for r in df.limit(MOST + 1).collect()]
        if len(rows) > MOST:
            raise ValueError(f"{name}: more than {MOST} names")
        key = (lambda r: (-r["total"], r["name"])) if name == "stages" else (lambda r, c=df.columns[0]: str(r[c]))
        out[name] = sorted(rows, key=key)
    return out


def duration(nanos: float) -> str:
    for unit, size in (("s", 1e9), ("ms", 1e6), ("us", 1e3)):
        if nanos >= size:
            return f"{nanos / size:.2f}{unit}"
    return f"{int(nanos)}ns"


def _cells(name: str, rows: list[dict], elapsed: float) -> list[list[str]]:
    times = {"total", "mean", "p50", "p95", "p99", "min", "max", "stddev", "wall", "cpu"}
    shown = lambda c, v: duration(v) if c in times else f"{v:.1f}%" if c in ("hit_rate", "efficiency", "utilisation") else str(v)
    out = [[*rows[0], *(["per second"] if name == "counters" else [])]]
    for r in rows:
        rate = [f"{r['value'] / elapsed:.1f}" if elapsed > 0 else ""] if name == "counters" else []
        out.append([shown(c, v) for c, v in r.items()] + rate)
    return out


def text_report(shot: dict) -> str:
    out = [f"elapsed {shot['elapsed']:.3f}s"]
    for name, rows in shot.items():
        if name != "elapsed" and rows:
            cells = _cells(name, rows, shot["elapsed"])
            wide = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
            out += ["", name] + ["  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, wide, strict=True))) for r in cells]
    return "\n".join(out) + "\n"


def json_report(shot: dict, pretty: bool = False) -> str:
    return json.dumps(shot, indent=2 if pretty else None)


def html_report(shot: dict) -> str:
    out = [f"<!doctype html><meta charset=utf-8><title>Profile</title><p>elapsed {shot['elapsed']:.3f}s</p>"]
    for name, rows in shot.items():
        if name != "elapsed" and rows:
            cells = _cells(name, rows, shot["elapsed"])
            line = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
            out.append(f"<h2>{html.escape(name)}</h2><table>{line(cells[0], 'th')}{''.join(line(r, 'td') for r in cells[1:])}</table>")
    return "".join(out)
