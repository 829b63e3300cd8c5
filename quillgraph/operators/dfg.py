"""Data-flow relations over (file, src, dst, variable, edge_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import reach
from quillgraph.plans.graph import Graph


def subtree(graph: Graph) -> DataFrame:
    """(file, top, node): each node with itself and its descendants."""
    own = graph.nodes.select("file", F.col("id").alias("top"), F.col("id").alias("node"))
    return own.unionByName(graph.ancestry.select("file", F.col("anc").alias("top"), F.col("desc").alias("node")))


def flows_to(graph: Graph) -> DataFrame:
    """(file, a, b): an edge leads from a's subtree to b's, but not to a itself unless directly."""
    edges = graph.table("dfg_edges").select("file", "src", "dst").distinct()
    below = subtree(graph)
    out = edges.join(below.withColumnsRenamed({"top": "a", "node": "src"}), ["file", "src"])
    out = out.join(below.withColumnsRenamed({"top": "b", "node": "dst"}), ["file", "dst"])
    out = out.where((F.col("dst") != F.col("a")) | ((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))))
    return out.select("file", "a", "b").distinct()


def reaches(graph: Graph, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(file, a, b) for the a of ``seeds`` (file, a): some node below a reaches some node below b other than
    a; every a reaches itself.  Only nodes below the seeds are followed."""
    below = subtree(graph)
    starts = seeds.select("file", F.col("a").alias("top")).distinct().join(below, ["file", "top"]).withColumnRenamed("top", "seed")
    # all nodes below a move together, as a's
    hit = reach(graph.spark, starts, graph.table("dfg_edges"), ["file"], blocked).where(F.col("node") != F.col("seed"))
    out = hit.select("file", F.col("seed").alias("a"), "node")
    out = out.join(below.withColumnRenamed("top", "b"), ["file", "node"]).select("file", "a", "b")
    return out.unionByName(seeds.select("file", "a", F.col("a").alias("b"))).distinct()


def reached_from(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(file, a, b) for the a of ``seeds`` (file, a): every node b that a flow leads from to a, a itself included."""
    edges = graph.table("dfg_edges").select("file", F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = reach(graph.spark, seeds.select("file", F.col("a").alias("seed")), edges, ["file"])
    return hit.select("file", F.col("seed").alias("a"), F.col("node").alias("b"))


def successors(graph: Graph) -> DataFrame:
    """(file, a, b): a single edge leads from a to b."""
    return graph.table("dfg_edges").select("file", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def predecessors(graph: Graph) -> DataFrame:
    """(file, a, b): a single edge leads from b to a."""
    return graph.table("dfg_edges").select("file", F.col("dst").alias("a"), F.col("src").alias("b")).distinct()


def labelled(graph: Graph, end: str, variable: str) -> DataFrame:
    """(file, a): nodes that are, or hold below them, an edge's ``src`` or ``dst`` for the variable."""
    ends = graph.table("dfg_edges").where(F.col("variable") == variable).select("file", F.col(end).alias("node")).distinct()
    return subtree(graph).join(ends, ["file", "node"], "left_semi").select("file", F.col("top").alias("a")).distinct()
