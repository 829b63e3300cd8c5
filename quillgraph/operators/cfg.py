"""Control-flow facts, one function a group.

A function's blocks fit a task, so each is one group (function graphs are
bounded by source functions, not by the corpus); groups are dealt by (file,
function), never by file alone, and equal graphs are computed once a task.
One pass gives every relation:

dom, postdom, reach (reflexive), scc (a: block, b: least block of its component),
frontier, loop (a: block in a loop, b: its header), noexit (a: block of a
component without an exit), exc (a: block on an exception path), idom.

Blocks are numbered from the entry 0; only ``normal`` edges carry dominance and
reachability; an unreachable block is dominated by itself alone.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.groups import by_shape


def closure(n: int, succ: dict[int, list[int]], start: list[int], without: int | None = None) -> set[int]:
    seen = {s for s in start if s != without}
    todo = list(seen)
    while todo:
        for y in succ.get(todo.pop(), ()):
            if y != without and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def dominators(nodes: list[int], entry: int, succ: dict[int, list[int]]) -> dict[int, set[int]]:
    """For each node the set of its dominators: those whose removal cuts it off from the entry."""
    alive = closure(len(nodes), succ, [entry])
    out = {v: {v} for v in nodes}
    for a in alive:
        if a == entry:
            kept = set()
        else:
            kept = closure(len(nodes), succ, [entry], without=a)
        for b in alive - kept:
            out[b].add(a)
    return out


def function_facts(blocks: list[int], edges: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    nodes = sorted(set(blocks))
    if not nodes:
        return []
    known = set(nodes)
    succ, pred, exc = defaultdict(list), defaultdict(list), []
    for a, b, kind in edges:
        if a in known and b in known:
            if kind == "exception":
                exc.append(b)
            elif b not in succ[a]:
                succ[a].append(b)
                pred[b].append(a)
    entry = nodes[0]
    out = []
    reach = {v: closure(len(nodes), succ, [v]) for v in nodes}
    out += [("reach", a, b) for a in nodes for b in sorted(reach[a])]
    dom = dominators(nodes, entry, succ)
    out += [("dom", a, b) for b in nodes for a in sorted(dom[b])]
    # by removal, the nearest strict dominator is the one with most dominators of its own
    idom = {b: max(dom[b] - {b}, key=lambda a: len(dom[a]), default=b) for b in nodes}
    out += [("idom", idom[b], b) for b in nodes]
    end = nodes[-1] + 1
    back = {v: list(pred[v]) for v in nodes}
    back[end] = [v for v in nodes if not succ[v]]
    post = dominators([*nodes, end], end, back)
    out += [("postdom", a, b) for b in nodes for a in sorted(post[b]) if a != end]
    front = {(x, y) for y in nodes for p in pred[y] for x in dom[p] if x == y or x not in dom[y]}
    out += [("frontier", x, y) for x, y in sorted(front)]
    component = {v: min(w for w in reach[v] if v in reach[w]) for v in nodes}
    out += [("scc", v, component[v]) for v in nodes]
    headers = {h for h in nodes if any(h in dom[p] for p in pred[h])}
    for v in nodes:
        # the nearest dominator that is a loop's header
        h = next((x for x in sorted(dom[v], key=lambda a: -len(dom[a])) if x in headers), None)
        if h is not None and (v == h or h in reach[v]):
            out.append(("loop", v, h))
        members = {w for w in nodes if component[w] == component[v]}
        if (len(members) > 1 or v in succ[v]) and all(y in members for w in members for y in succ[w]):
            out.append(("noexit", v, component[v]))
    out += [("exc", v, v) for v in sorted(closure(len(nodes), succ, exc))]
    return out


def facts(spark: SparkSession, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, function, fact, a, b)."""
    rows = blocks.select("file", "function", F.lit(None).cast("string").alias("kind"), F.col("block_ord").alias("a"), F.lit(None).cast("long").alias("b"))
    rows = rows.unionByName(edges.select("file", "function", F.coalesce("kind", F.lit("normal")).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))

    def run(given):
        own = [r["a"] for r in given if r["kind"] is None]
        return function_facts(own, [(r["a"], r["b"], r["kind"]) for r in given if r["kind"] is not None])

    return by_shape(rows, ["file", "function"], run, "fact string, a long, b long", ["a", "b"], words=["kind"])


def reach_without(spark: SparkSession, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The (file, function, a, barrier, b) of ``asked`` (file, function, a, barrier) that a path of normal
    edges reaches without entering the barrier; a itself is reached."""
    from quillgraph.operators.closure import durable

    edges = edges.where("kind <> 'exception'").select("file", "function", "src", "dst").distinct()
    front = asked.select("file", "function", "a", "barrier").distinct().withColumn("b", F.col("a"))
    seen = front = durable(spark, front, "without")
    keys = ["file", "function", "a", "barrier", "b"]
    while True:
        step = front.join(edges.withColumnRenamed("src", "b"), ["file", "function", "b"]).where("dst <> barrier")
        step = step.select("file", "function", "a", "barrier", F.col("dst").alias("b")).distinct().join(seen, keys, "left_anti")
        front = durable(spark, step, "without")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
