"""Analyses computed once per graph: alias, size, nullability, constants, calls, classes, measures and rewrites."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.kinds import NULLABLE_CALLS
from quillgraph.operators.closure import durable, nearest_seed, reach
from quillgraph.operators.groups import by_shape
from quillgraph.plans.graph import Graph

#: Edge types that carry a null value.
NULL_EDGES = ["REACHING_DEF", "CALL_RETURN", "INTERPROCEDURAL_FLOW"]


def points_to(graph: Graph) -> DataFrame:
    """(file, pointer, target)."""
    edges = graph.table("dfg_edges").where("edge_type = 'POINTS_TO'")
    return edges.select("file", F.col("src").alias("pointer"), F.col("dst").alias("target")).distinct()


def may_alias(graph: Graph) -> DataFrame:
    """(file, a, b), a < b: pointers that share a target."""
    p = points_to(graph)
    out = p.select("file", "target", F.col("pointer").alias("a")).join(p.select("file", "target", F.col("pointer").alias("b")), ["file", "target"])
    return out.where("a < b").select("file", "a", "b").distinct()


def nullability(graph: Graph, calls: list[str] = NULLABLE_CALLS) -> DataFrame:
    """(file, node, source): nodes that may be null, and the nearest seed (the least of equally near ones)."""
    n = graph.nodes
    short = F.regexp_extract("name", r"[^:.]+$", 0)
    seeds = n.where(
        ((F.col("kind") == "Literal") & (F.col("lit_kind") == "Null")) | ((F.col("kind") == "Call") & short.isin(calls))
    )
    edges = graph.table("dfg_edges").where(F.col("edge_type").isin(NULL_EDGES))
    return nearest_seed(graph.spark, seeds.select("file", F.col("id").alias("seed")), edges, ["file"]).select("file", "node", F.col("seed").alias("source"))


def arguments(graph: Graph, kind: str | None = None) -> DataFrame:
    """(file, call, args): the children of a node's first argument list, else its own children; of nodes of the kind."""
    n = graph.nodes
    lists = n.where(F.col("node_type").isin("argument_list", "arguments")).groupBy("file", F.col("parent_id").alias("call"))
    lists = lists.agg(F.min_by("children", "id").alias("inner"))
    n = n if kind is None else n.where(F.col("kind") == kind)
    out = n.select("file", F.col("id").alias("call"), "children").join(lists, ["file", "call"], "left")
    return out.select("file", "call", F.coalesce("inner", "children", F.array().cast("array<bigint>")).alias("args"))


def sizes(graph: Graph) -> DataFrame:
    """(file, node, size_int, size_expr): known sizes of declarations, literals and heap calls, by priority; a heap
    call's is its folded argument, calloc's the product of two, or their text."""
    n = graph.nodes
    calls = n.where((F.col("kind") == "Call") & F.col("name").isin("malloc", "alloca", "valloc", "calloc")).select("file", F.col("id").alias("call"), "name")
    calls = calls.join(arguments(graph, "Call"), ["file", "call"])
    value = graph.constants.select("file", F.col("node").alias("arg"), "value")
    word = n.select("file", F.col("id").alias("arg"), F.col("text").alias("word"))
    for i in range(2):
        calls = calls.withColumn("arg", F.get("args", F.lit(i))).join(value, ["file", "arg"], "left").join(word, ["file", "arg"], "left")
        calls = calls.withColumnsRenamed({"value": f"v{i}", "word": f"t{i}"}).drop("arg")
    product = F.col("name") == "calloc"
    calls = calls.select(
        "file", F.col("call").alias("id"), F.when(product, F.col("v0") * F.col("v1")).otherwise(F.col("v0")).alias("heap"),
        F.when(product, F.concat("t0", F.lit(" * "), "t1")).otherwise(F.col("t0")).alias("heap_expr"),
    )
    size = F.coalesce(
        "array_size",
        F.col("array_size_expr").try_cast("bigint"),
        F.when(F.col("lit_kind").isin("String", "Bytes"), F.col("string_length") + F.col("lang").isin("c", "cpp").cast("long")),
        F.when(F.col("kind") == "CollectionExpr", F.size("children").cast("long")),
        "heap",
    )
    out = n.join(calls, ["file", "id"], "left").select(
        "file", F.col("id").alias("node"), size.alias("size_int"),
        F.when(size.isNull(), F.coalesce("array_size_expr", "heap_expr")).alias("size_expr"),
    )
    return out.where("size_int IS NOT NULL OR size_expr IS NOT NULL")


def parameters(graph: Graph) -> DataFrame:
    """(file, fn, params): ids of a function's parameters in order, taken from its own children, from a list among
    them, or from the list of its declarator; the nameless ``void`` of C is none."""
    n = graph.nodes
    void = n.where("node_type = 'primitive_type' AND text = 'void'").select("file", F.col("parent_id").alias("id"))
    own = n.where("kind = 'ParamDef'").select("file", "id", "node_type", "name", F.col("parent_id").alias("up"), F.size("children").alias("size"))
    nameless = F.col("node_type").eqNullSafe("parameter_declaration") & F.col("name").isNull() & (F.col("size") == 1)
    own = own.where(~nameless).drop("size").unionByName(own.where(nameless).drop("size").join(void, ["file", "id"], "left_anti"))
    at = F.posexplode("children").alias("at", "id")
    place = n.where("kind = 'MethodDef' OR node_type IN ('parameter_list', 'formal_parameters', 'parameters', 'function_declarator')").select("file", at)
    outer = n.select("file", F.col("id").alias("up"), F.col("kind").alias("k"), F.col("node_type").alias("t"), F.col("parent_id").alias("next"))
    step = own.join(place, ["file", "id"]).join(outer, ["file", "up"])
    lists = ["parameter_list", "formal_parameters", "parameters"]
    found = step.where("k = 'MethodDef'").select("file", F.col("up").alias("fn"), F.array(F.col("at").cast("long")).alias("order"), "id")
    inner = step.where(F.col("t").isin(lists) & (F.col("k") != "MethodDef")).select("file", "id", F.array(F.col("at").cast("long")).alias("order"), F.col("up").alias("box"), F.col("next").alias("up"))
    spot = place.select("file", F.col("id").alias("box"), F.col("at").alias("box_at"))
    step = inner.join(outer, ["file", "up"]).join(spot, ["file", "box"], "left")
    order = F.concat(F.array(F.coalesce("box_at", F.lit(0)).cast("long")), "order")
    found = found.unionByName(step.where("k = 'MethodDef'").select("file", F.col("up").alias("fn"), order.alias("order"), "id"))
    inner = step.where("t = 'function_declarator' AND k <> 'MethodDef'").select("file", "id", order.alias("order"), F.col("up").alias("box"), F.col("next").alias("up"))
    step = inner.join(outer, ["file", "up"]).join(spot, ["file", "box"], "left")
    found = found.unionByName(step.where("k = 'MethodDef'").select("file", F.col("up").alias("fn"), order.alias("order"), "id"))
    rows = found.groupBy("file", "fn").agg(F.array_sort(F.collect_list(F.struct("order", "id"))).alias("p"))
    return rows.select("file", "fn", F.transform("p", lambda x: x["id"]).alias("params"))


def conditions(graph: Graph, kinds: list[str] | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(file, id, condition) of nodes of the kinds (of all without): the child of the field ``condition``, else the first
    child; and ``more`` columns."""
    at = F.array_position(F.coalesce("field_names", F.array().cast("array<string>")), "condition").cast("int")
    named = F.when(at > 0, F.get("children", at - 1))
    nodes = graph.nodes if kinds is None else graph.nodes.where(F.col("kind").isin(kinds))
    given = [c.alias(name) for name, c in (more or {}).items()]
    return nodes.select("file", "id", F.coalesce(named, F.get("children", F.lit(0))).alias("condition"), *given)


def guarding(graph: Graph, kinds: list[str]) -> DataFrame:
    """(file, desc, condition) of the nearest node of the kinds at or above each node, up to 512 edges away.

    One pass over functions finds it; pairs of ancestors are joined only for nodes whose way up leaves their function
    before it meets a guard.  Nodes without a function stand with the function that they are, or alone."""
    guard = F.col("kind").isin(kinds)
    more = {"fn": F.coalesce("function_id", "id"), "parent_id": F.col("parent_id"), "tag": F.when(guard, "guard")}
    rows = conditions(graph, more=more).withColumn("condition", F.when(F.col("tag").isNotNull(), F.col("condition")))

    def run(given):
        rows = {r["id"]: r for r in given}
        # (guard, edges to it, whether the way up leaves the rows)
        best = {i: (i, 0, False) for i, r in rows.items() if r["tag"] is not None}
        for i in rows:
            way, met = {}, i
            while met in rows and met not in best and met not in way:
                way[met] = None
                met = rows[met]["parent_id"]
            above, far, left = best.get(met, (None, 0, met is not None and met not in rows))
            for x in reversed(way):
                far += 1
                best[x] = above, far, left
        held = [(i, rows[g]["condition"], 1) for i, (g, far, _) in best.items() if g is not None and far <= 512]
        return held + [(i, None, 0) for i, (g, _, left) in best.items() if g is None and left]

    done = by_shape(rows, ["file", "fn"], run, "desc long, condition long, held long", ["id", "parent_id", "condition"], "id", words=["tag"], shifted=["desc", "condition"])
    done = durable(graph.spark, done.drop("fn"), "guarding")
    found, rest = done.where("held = 1").drop("held"), done.where("held = 0").select("file", "desc")
    if rest.isEmpty():
        return found
    own = conditions(graph, kinds).withColumnRenamed("id", "anc")
    above = graph.ancestry.join(rest, ["file", "desc"], "left_semi").join(own, ["file", "anc"])
    return found.unionByName(above.groupBy("file", "desc").agg(F.min_by("condition", "depth").alias("condition")))


def block_conditions(graph: Graph) -> DataFrame:
    """(file, function, src, value): blocks of two or more normal successors that hold a constant condition."""
    normal = graph.table("cfg_edges").where("kind IS NULL OR kind <> 'exception'")
    forks = normal.groupBy("file", "function", "src").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    known = conditions(graph, ["Conditional", "Loop", "Switch"]).where("condition IS NOT NULL")
    known = known.join(graph.constants.withColumnRenamed("node", "condition"), ["file", "condition"])
    places = graph.table("block_nodes").select("file", "function", F.col("block_ord").alias("src"), F.col("node_id").alias("condition"))
    known = known.join(places, ["file", "condition"]).join(forks.select("file", "function", "src"), ["file", "function", "src"])
    return known.groupBy("file", "function", "src").agg(F.max_by("value", "condition").alias("value"))


def feasible_edges(graph: Graph) -> DataFrame:
    """Control-flow edges without the dead arm of blocks with two successors and a constant condition: a true one
    follows the first edge (in order of ``arm``, then of target), a false one the second."""
    edges = graph.table("cfg_edges")
    fork = Window.partitionBy("file", "function", "src")
    normal = edges.where("kind IS NULL OR kind <> 'exception'").withColumns(
        {"way": F.row_number().over(fork.orderBy("arm", "dst")), "ways": F.count(F.lit(1)).over(fork)}
    )
    normal = normal.join(block_conditions(graph), ["file", "function", "src"], "left")
    dead = F.coalesce((F.col("ways") == 2) & (F.col("way") == F.when(F.col("value") != 0, 2).when(F.col("value") == 0, 1)), F.lit(False))
    return normal.where(~dead).select(*edges.columns).unionByName(edges.where("kind = 'exception'"))


_BINARY = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "&": operator.and_, "|": operator.or_, "^": operator.xor,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne,
}


def fold(op: str | None, values: list[int]) -> int | None:
    """64-bit wrapping arithmetic of one operator; None where it has no value."""
    wrap = lambda x: (int(x) + (1 << 63)) % (1 << 64) - (1 << 63)
    if len(values) == 2 and op in _BINARY:
        return wrap(_BINARY[op](*values))
    if len(values) == 2:
        a, b = values
        if op in ("/", "%") and b:
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return wrap(q) if op == "/" else wrap(a - q * b)
        if op in ("<<", ">>") and 0 <= b < 64:
            return wrap(a << b) if op == "<<" else a >> b
        if op in ("&&", "||"):
            return int(bool(a) and bool(b)) if op == "&&" else int(bool(a) or bool(b))
        return None
    if len(values) == 1:
        (a,) = values
        return {"-": wrap(-a), "~": wrap(~a), "!": int(not a), "not": int(not a), "+": a}.get(op)
    return None


def number(text: str) -> int | None:
    try:
        value = ast.literal_eval(text.strip().rstrip("uUlL"))
    except (ValueError, SyntaxError, MemoryError):
        return None
    return value if type(value) is int and -(1 << 63) <= value < 1 << 63 else None


def folded(given: list[dict]) -> dict[int, int | None]:
    """Values of the expressions of one function, bottom up; None where there is none."""
    rows = {r["id"]: r for r in given}
    known: dict[int, int | None] = {}

    def own(i: int) -> int | None:
        r = rows[i]
        below = r["children"]
        # of a binary operator the outer children count, of what has one operand the last
        values = [known.get(c) for c in (below if len(below) < 2 else [below[0], below[-1]] if r["kind"] == "BinaryOp" else below[-1:])]
        if r["kind"] == "Literal":
            if r["lit_kind"] == "Null":
                return 0
            if r["lit_kind"] == "Bool":
                return int((r["text"] or "").lower() == "true")
            return number(r["text"] or "") if r["lit_kind"] == "Int" else None
        if r["kind"] in ("Cast",) or r["node_type"] == "parenthesized_expression":
            return values[-1] if values else None
        if r["kind"] in ("BinaryOp", "UnaryOp") and values and None not in values:
            return fold(r["operator"], values)
        return None

    for i in rows:
        todo = [i]
        while todo:
            x = todo[-1]
            wait = [c for c in rows[x]["children"] if c in rows and c not in known and c != x]
            if wait and x not in known:
                known[x] = None  # a cycle has no value
                todo += wait
                continue
            todo.pop()
            known[x] = own(x)
    return known


#: Kinds whose nodes may have a constant value; parentheses may as well.
VALUED = ["Literal", "BinaryOp", "UnaryOp", "Cast"]


def constants(graph: Graph) -> DataFrame:
    """(file, node, value): integer values of constant expressions, bottom up, one function (or a file's
    top level) a group, equal functions once: an expression never leaves its function."""

    def run(given):
        return [(i, v) for i, v in folded(given).items() if v is not None]

    n = graph.nodes.where(F.col("kind").isin(VALUED) | (F.col("node_type") == "parenthesized_expression"))
    word = F.when(F.col("kind") == "Literal", F.col("text")).alias("text")
    n = n.select("file", F.coalesce("function_id", F.lit(-1)).alias("fn"), "id", "kind", "node_type", "lit_kind", word, "operator", "children")
    out = by_shape(n, ["file", "fn"], run, "node long, value long", ["id"], "id", ["children"], ["kind", "node_type", "lit_kind", "text", "operator"], ["node"])
    return out.select("file", "node", "value")


def resolve_callees(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, call_node, target_file, target): calls joined to definitions by qualified name first, then by
    simple name; of several the own file's, then the least (file, id).

    calls: (file, call_node, callee_name, qualified_callee); definitions: (file, id, name, qualified_name)."""
    keys = definitions.select(F.col("file").alias("target_file"), F.col("id").alias("target"), F.explode(F.array_compact(F.array(
        F.struct(F.col("qualified_name").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("name").alias("key"), F.lit(1).alias("rank"))))).alias("k"))
    keys = keys.select("target_file", "target", "k.key", "k.rank").where("key IS NOT NULL")
    asked = calls.select("file", "call_node", F.explode(F.array(
        F.struct(F.col("qualified_callee").alias("key"), F.lit(0).alias("ask")), F.struct(F.col("callee_name").alias("key"), F.lit(1).alias("ask")))).alias("a"))
    asked = asked.select("file", "call_node", "a.key", "a.ask").where("key IS NOT NULL")
    # one row a key, and one a key and file, so a name that many define costs a call no more than another
    least = keys.groupBy("key").agg(F.min(F.struct("rank", "target_file", "target")).alias("any"))
    own = keys.groupBy("key", F.col("target_file").alias("file")).agg(F.min(F.struct("rank", "target")).alias("own"))
    hit = asked.join(least, "key").join(own, ["key", "file"], "left")
    near = F.col("own.rank").eqNullSafe(F.col("any.rank"))
    place = lambda c, own: F.when(near, own).otherwise(F.col(f"any.{c}")).alias(c)
    rank = F.struct("ask", F.col("any.rank").alias("rank"), place("target_file", F.col("file")), place("target", F.col("own.target")))
    return hit.groupBy("file", "call_node").agg(F.min(rank).alias("b")).select("file", "call_node", "b.target_file", "b.target")


def class_closure(graph: Graph) -> DataFrame:
    """(file, child, ancestor, hops) over supertypes."""
    t = graph.table("supertypes")
    edges = t.select("file", F.col("child").alias("src"), F.col("parent").alias("dst"))
    hit = reach(graph.spark, edges.select("file", F.col("src").alias("seed")), edges, ["file"])
    return hit.where("hops > 0").select("file", F.col("seed").alias("child"), F.col("node").alias("ancestor"), "hops")


def histogram(samples: DataFrame, by: list[str], value: str, order: list[str], cap: int = 2000) -> DataFrame:
    """count, min, max, mean (whole), p50, p95, p99 (nearest rank of the first ``cap`` samples in order), stddev (of
    these samples around the mean of all, whole; 0 for a single one)."""
    first = Window.partitionBy(*by).orderBy(*order)
    kept = samples.withColumn("_i", F.row_number().over(first))
    sample = F.array_sort(F.collect_list(F.when(F.col("_i") <= cap, F.col(value))))
    out = kept.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.floor(F.sum(value) / F.count(value)).cast("long").alias("mean"), sample.alias("_s"),
    )
    rank = lambda p: F.get("_s", F.floor((F.size("_s") - 1) * p / 100 + F.lit(0.5)).cast("int"))
    # squares are summed exactly, so the order of samples does not matter
    exact = lambda x: (x - F.col("mean")).cast("decimal(19,0)")
    squares = F.aggregate("_s", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + exact(x) * exact(x)).cast("decimal(38,0)"))
    spread = F.when(F.size("_s") < 2, F.lit(0)).otherwise(F.floor(F.sqrt(squares.cast("double") / F.size("_s")))).cast("long")
    return out.select(*by, "n", "min", "max", "mean", *[rank(p).alias(f"p{p}") for p in (50, 95, 99)], spread.alias("stddev"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Percent of hits, 0 where nothing was asked."""
    total = hits + misses
    return F.when(total > 0, 100.0 * hits / total).otherwise(F.lit(0.0))


def prune(graph: Graph, edges: DataFrame, kind: str = "Identifier") -> DataFrame:
    """(file, src, dst): edges with nodes of the kind collapsed into their parents; loops and repeats go."""
    up = graph.nodes.where((F.col("kind") == kind) & F.col("parent_id").isNotNull()).select("file", "id", "parent_id")
    for end in ("src", "dst"):
        to = up.select("file", F.col("id").alias(end), F.col("parent_id").alias("_to"))
        edges = edges.join(to, ["file", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where("src <> dst").select("file", "src", "dst").distinct()


def anonymize(graph: Graph, prefix: str = "var") -> DataFrame:
    """(file, id, name): names replaced by prefix and the rank of their first node in the file."""
    first = graph.nodes.where("name IS NOT NULL").groupBy("file", "name").agg(F.min("id").alias("at"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("at", "name"))
    names = first.select("file", "name", F.concat(F.lit(prefix), rank.cast("string")).alias("anon"))
    return graph.nodes.join(names, ["file", "name"]).select("file", "id", F.col("anon").alias("name"))


def subgraph(graph: Graph, seeds: DataFrame, cap: int = 200) -> DataFrame:
    """(file, seed, node, depth): nodes below each seed, breadth first, ``cap`` at most (the report's limit)."""
    below = graph.ancestry.select("file", F.col("anc").alias("seed"), F.col("desc").alias("node"), "depth")
    out = seeds.select("file", "seed").distinct().join(below, ["file", "seed"])
    rank = F.row_number().over(Window.partitionBy("file", "seed").orderBy("depth", "node"))
    return out.withColumn("_k", rank).where(F.col("_k") < cap).drop("_k")


def size_estimate(graph: Graph) -> DataFrame:
    """(file, total_nodes, bytes): 256 a node, 128 a block, 32 a data-flow edge."""
    parts = [("nodes", 256), ("blocks", 128), ("dfg_edges", 32)]
    rows = None
    for name, size in parts:
        p = graph.table(name).select("file", F.lit(size).cast("long").alias("b"), F.lit(int(name == "nodes")).cast("long").alias("n"))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy("file").agg(F.sum("n").alias("total_nodes"), F.sum("b").alias("bytes"))


