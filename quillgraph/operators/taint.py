"""Taint: which sources reach which sinks.

Sources, sinks and sanitizers are named node sets (of the rule file, or of a
registry of functions from a graph to (file, node)).  Flow is bounded
reachability over data-flow and propagator edges that never enters a sanitizer,
plus edges from call arguments to calls whose summaries return or write the
argument.  All sources move together, keyed by (file, seed), so one semi-naive
loop answers every pair; paths are walked back from least hop counts.  Calls into
other files become edges as well, where the callee returns a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import language as L
from quillgraph.operators.analyses import resolve_callees
from quillgraph.operators.closure import durable, reach
from quillgraph.plans.graph import Graph

Registry = dict[str, Callable[[Graph], DataFrame]]


def registry(specs: list[tuple[str, str, list[int]]]) -> Registry:
    """Named sets from (set, function, argument positions): the arguments at the positions of calls to the
    function, or the call itself where none are given.  ``pkg.f`` and ``ns::f`` are calls to ``f``."""

    def member(rows: list[tuple[str, list[int]]]):
        def nodes(graph: Graph) -> DataFrame:
            # a list that stands in the rule's configuration
            known = graph.spark.createDataFrame(rows, "function string, args array<long>")
            calls = graph.nodes.where("kind = 'Call'").select("file", "id", "children", F.regexp_extract("name", r"[^:.]+$", 0).alias("function"))
            hit = calls.join(F.broadcast(known), "function")
            whole = hit.where("size(args) = 0").select("file", F.col("id").alias("node"))
            args = hit.select("file", "children", F.explode("args").alias("i"))
            args = args.select("file", F.get("children", F.col("i").cast("int")).alias("node")).where("node IS NOT NULL")
            return whole.unionByName(args).distinct()

        return nodes

    return {name: member([(f, a) for s, f, a in specs if s == name]) for name in {s for s, _, _ in specs}}


def endpoint(compiler, name: str, known: Registry | None) -> DataFrame:
    """(file, node) of a named set; a definition of the rule file wins, an unknown name is empty."""
    d = compiler.rules.definitions.get(name)
    out = None
    if d is not None and d.finds:
        for clause in d.finds:
            env = compiler.find(clause)
            for var, _ in clause.bindings:
                part = env.select("file", F.col(f"{var}.id").alias("node"))
                out = part if out is None else out.unionByName(part)
    elif known and name in known:
        out = known[name](compiler.graph).select("file", "node")
    if out is None:
        out = compiler.graph.nodes.where(F.lit(False)).select("file", F.col("id").alias("node"))
    return out.distinct()


def union(compiler, names: list[str], registry) -> DataFrame:
    out = endpoint(compiler, "", None)
    for n in names:
        out = out.unionByName(endpoint(compiler, n, registry))
    return out.distinct()


def summary_edges(graph: Graph) -> DataFrame:
    """(file, src, dst): from the argument to the call, where the callee returns or writes that argument."""
    effects = graph.table("param_effects").where(F.col("effect").isin("TaintReturn", "TaintOut"))
    effects = effects.select(F.col("fn_name").alias("callee"), "idx").distinct()
    calls = graph.nodes.where(F.col("kind") == "Call").select("file", F.col("id").alias("dst"), F.col("name").alias("callee"), F.posexplode("children").alias("idx", "src"))
    return calls.join(effects, ["callee", "idx"]).select("file", "src", "dst")


def cross_file_edges(graph: Graph) -> DataFrame:
    """(file, src, dst): from the argument to the call, where the callee, in whichever file, returns that argument.

    Parameters flow inside their own file, past any sanitizer.  Edges that are found lead on from parameters of
    other functions, so rounds go on until none is new; each is written."""
    n, spark = graph.nodes, graph.spark
    calls = graph.table("xcalls").where("call_node IS NOT NULL")
    target = resolve_callees(calls, n.where("kind = 'MethodDef'").select("file", "id", "name", "qualified_name"))
    place = F.row_number().over(Window.partitionBy("file", "function_id").orderBy("line", "column", "id")).cast("long") - 1
    params = n.where("kind = 'ParamDef' AND function_id IS NOT NULL").withColumn("idx", place)
    params = params.select(F.col("file").alias("target_file"), F.col("function_id").alias("target"), "idx", F.col("id").alias("seed"))
    params = durable(spark, params.join(target.select("target_file", "target").distinct(), ["target_file", "target"]), "params")
    returns = n.where("kind = 'Return'").select(F.col("file").alias("target_file"), F.col("function_id").alias("target"), F.col("id").alias("node"))
    args = n.where("kind = 'Call'").select("file", F.col("id").alias("call_node"), F.posexplode("children").alias("i", "arg"))
    args = args.join(calls.select("file", "call_node", "arg_positions"), ["file", "call_node"])
    args = args.withColumn("idx", F.coalesce(F.get("arg_positions", F.col("i")), F.col("i").cast("long")))
    args = durable(spark, args.join(target, ["file", "call_node"]).select("file", "call_node", "arg", "idx", "target_file", "target"), "args")
    base = graph.table("dfg_edges").select("file", "src", "dst").unionByName(summary_edges(graph))
    found = durable(spark, base.limit(0), "crossed")
    while True:
        hit = reach(spark, params.select(F.col("target_file").alias("file"), "seed"), base.unionByName(found), ["file"])
        back = hit.withColumnRenamed("file", "target_file").join(params, ["target_file", "seed"]).join(returns, ["target_file", "target", "node"])
        back = back.select("target_file", "target", "idx").distinct()
        more = args.join(back, ["target_file", "target", "idx"]).select("file", F.col("arg").alias("src"), F.col("call_node").alias("dst"))
        more = durable(spark, more.distinct(), "crossed")
        if not more.join(found, ["file", "src", "dst"], "left_anti").limit(1).count():
            return more
        found = more


def propagator_edges(compiler, names: list[str]) -> DataFrame:
    """(file, src, dst) of the rule file's propagators, where both ends are a call's arguments or the call."""
    out = compiler.graph.nodes.where(F.lit(False)).select("file", F.col("id").alias("src"), F.col("id").alias("dst"))
    for n in names:
        d = compiler.rules.definitions.get(n)
        if d is None or d.role != "propagator" or not d.params:
            continue
        var, type_ = d.params[0]
        env = compiler.keep(compiler.candidates(var, type_), compiler.inline(d.body), {var})
        env, a = compiler.value(env, d.edge["from"], {var})
        env, b = compiler.value(env, d.edge["to"], {var})
        if a.kind == b.kind == "node":
            ends = env.select("file", a.column["id"].alias("src"), b.column["id"].alias("dst"))
            out = out.unionByName(ends.where("src IS NOT NULL AND dst IS NOT NULL"))
    return out


def flows(graph: Graph, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None, extra: DataFrame | None = None, most: int | None = 21) -> DataFrame:
    """(file, source, sink, hops) of every pair of (file, node) sets that flow joins within ``most`` edges."""
    edges = graph.table("dfg_edges").select("file", "src", "dst")
    edges = edges.unionByName(summary_edges(graph)) if "param_effects" in graph.tables else edges
    edges = edges.unionByName(extra) if extra is not None else edges
    hit = reach(graph.spark, sources.select("file", F.col("node").alias("seed")), edges, ["file"], sanitizers, most)
    return hit.join(sinks.select("file", "node").distinct(), ["file", "node"]).select(
        "file", F.col("seed").alias("source"), F.col("node").alias("sink"), "hops"
    )


def paths(graph: Graph, pairs: DataFrame, hit: DataFrame) -> DataFrame:
    """``pairs`` (file, source, sink, hops) with path: the least nodes of a shortest path, walked back a hop a round along
    the ``src`` of ``hit``."""
    out = durable(graph.spark, pairs.withColumn("path", F.array("sink")), "paths")
    before = hit.where("hops > 0").select("file", F.col("seed").alias("source"), F.col("node").alias("dst"), "src")
    while True:
        open_ = F.size("path") <= F.col("hops")
        if not out.where(open_).limit(1).count():
            return out
        step = out.where(open_).withColumn("dst", F.get("path", F.lit(0)))
        step = step.join(before, ["file", "source", "dst"]).withColumn("path", F.concat(F.array("src"), F.col("path")))
        out = durable(graph.spark, out.where(~open_).unionByName(step.select(*out.columns)), "paths")


def run_clause(compiler, rule: L.Rule, clause: L.Taint, registry: Registry | None) -> DataFrame:
    """Findings of a taint clause, one a (source, sink) pair, located at the source, with the path."""
    graph = compiler.graph
    sources, sinks = (union(compiler, clause.refs.get(k, []), registry) for k in ("sources", "sinks"))
    sanitizers = union(compiler, clause.refs.get("sanitizers", []), registry)
    extra = propagator_edges(compiler, clause.refs.get("propagators", []))
    if "xcalls" in graph.tables:
        extra = extra.unionByName(cross_file_edges(graph))
    most = 2 * clause.max_call_depth + 1
    edges = graph.table("dfg_edges").select("file", "src", "dst").unionByName(summary_edges(graph)).unionByName(extra).distinct()
    hit = reach(graph.spark, sources.select("file", F.col("node").alias("seed")), edges, ["file"], sanitizers, most, via=True)
    pairs = hit.join(sinks, ["file", "node"]).select("file", F.col("seed").alias("source"), F.col("node").alias("sink"), "hops")
    node = lambda n: graph.nodes.select("file", F.col("id").alias(n), F.struct("function_id", "line", "end_line", "column", "end_column").alias(f"{n}_at"))
    if clause.require_same_function:
        pairs = pairs.join(node("source"), ["file", "source"]).join(node("sink"), ["file", "sink"])
        pairs = pairs.where("source_at.function_id = sink_at.function_id").select("file", "source", "sink", "hops")
    if clause.refs.get("guards"):
        pairs = unguarded(compiler, pairs, hit, clause.refs["guards"], registry)
    out = paths(graph, pairs, hit).join(node("source"), ["file", "source"])
    at = F.col("source_at")
    return out.select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"),
        F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>").alias("tags"), "file", at["line"].alias("line"),
        at["end_line"].alias("end_line"), at["column"].alias("column"), at["end_column"].alias("end_column"),
        F.col("path").alias("matched_nodes"),
    )


def unguarded(compiler, pairs: DataFrame, hit: DataFrame, names: list[str], registry) -> DataFrame:
    """Drops pairs whose sink a condition dominates that calls a guard on something the source reaches."""
    graph = compiler.graph
    guards = union(compiler, names, registry)
    n = graph.nodes
    tests = n.where(F.col("kind") == "Conditional").select("file", F.col("id").alias("test"), F.col("line").alias("test_line"), "function_id")
    inside = graph.ancestry.select("file", F.col("anc").alias("test"), F.col("desc").alias("node")).join(guards, ["file", "node"])
    args = n.select("file", F.col("id").alias("node"), F.explode("children").alias("arg"))
    checks = tests.join(inside, ["file", "test"]).join(args, ["file", "node"])
    at = compiler.placed().select("file", "function", "block", "node")
    dom = graph.flow_facts.where("fact = 'dom'").select("file", "function", F.col("a").alias("tb"), F.col("b").alias("sb"))
    checks = checks.join(at.withColumnsRenamed({"block": "tb", "node": "test", "function": "function"}), ["file", "test"])
    sinks = pairs.join(n.select("file", F.col("id").alias("sink"), F.col("line").alias("sink_line"), F.col("function_id").alias("function")), ["file", "sink"])
    sinks = sinks.join(at.withColumnsRenamed({"block": "sb", "node": "sink"}), ["file", "function", "sink"])
    bad = sinks.join(checks.select("file", "function", "tb", "test_line", "arg"), ["file", "function"]).where("test_line <= sink_line")
    bad = bad.join(dom, ["file", "function", "tb", "sb"])
    bad = bad.join(hit.select("file", F.col("seed").alias("source"), F.col("node").alias("arg")), ["file", "source", "arg"])
    return pairs.join(bad.select("file", "source", "sink").distinct(), ["file", "source", "sink"], "left_anti")
