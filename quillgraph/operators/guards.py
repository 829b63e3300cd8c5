"""Guards: what a condition establishes about a value on the branch that reaches a target.

Both questions are asked for whole tables of (file, guard, value, target, capacity); a question is held if its row comes
back.  What stays inside a function is answered in one pass over functions; questions whose trees or flows leave the
guard's function are answered by joins over the subtrees of the conditions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.analyses import VALUED, arguments, conditions, folded
from quillgraph.operators.closure import durable, reach
from quillgraph.operators.groups import by_shape
from quillgraph.plans.graph import Graph

#: A capacity that isn't known.
UNKNOWN = -(1 << 63)
#: Functions that return a length: fixed values.
LENGTH_CALLS = ["strlen", "strnlen", "wcslen"]
ASKED = ["file", "guard", "value", "target", "capacity"]
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
#: What the pass says of a question: not held, held, not to be answered inside the function; or a node that has a child
#: in another function.
NOT, HELD, OPEN, LEFT = range(4)


def _mapped(op: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), op)


def flipped(op: Column) -> Column:
    """The comparison read from its other side."""
    return _mapped(op, FLIPPED)


def opposite(op: Column) -> Column:
    return _mapped(op, OPPOSITE)


def _below(graph: Graph, tops: DataFrame, top: str, node: str) -> DataFrame:
    """``tops`` (file, top, ...) once for each node at or below ``top``, which is in ``node``."""
    down = graph.ancestry.select("file", F.col("anc").alias(top), F.col("desc").alias(node))
    return tops.withColumn(node, F.col(top)).unionByName(tops.join(down, ["file", top]))


def occurrences(graph: Graph, values: DataFrame, places: DataFrame) -> DataFrame:
    """(file, value, place): the places (file, value, place) that stand for the value: itself, or what a flow from
    below the value reaches below the place."""
    places = durable(graph.spark, places.distinct(), "guards")
    start = durable(graph.spark, _below(graph, values.select("file", "value").distinct(), "value", "seed"), "guards")
    hit = reach(graph.spark, start.select("file", "seed"), graph.table("dfg_edges"), ["file"])
    reached = start.join(hit, ["file", "seed"]).where(F.col("node") != F.col("value")).select("file", "value", "node").distinct()
    same = places.where(F.col("place") == F.col("value")).select("file", "value", "place")
    inner = _below(graph, places.select("file", "value", "place"), "place", "node")
    return inner.join(reached, ["file", "value", "node"], "left_semi").select("file", "value", "place").unionByName(same).distinct()


def _roots(graph: Graph, asked: DataFrame) -> DataFrame:
    """``asked`` with the condition of each guard (its own where it has no children) and whether the target is in
    its consequence."""
    at = F.array_position(F.coalesce("field_names", F.array().cast("array<string>")), "consequence").cast("int")
    tested = conditions(graph, more={"top": F.when(at > 0, F.get("children", at - 1))})
    tested = tested.select("file", F.col("id").alias("guard"), F.coalesce("condition", "id").alias("root"), "top")
    rows = durable(graph.spark, asked.join(tested, ["file", "guard"]), "guards")
    inside = graph.ancestry.select("file", F.col("anc").alias("top"), F.col("desc").alias("target"))
    inside = rows.select("file", "top", "target").distinct().join(inside, ["file", "top", "target"]).withColumn("then", F.lit(True))
    rows = rows.join(inside, ["file", "top", "target"], "left")
    rows = rows.withColumn("then", F.coalesce(F.col("then") | (F.col("top") == F.col("target")), F.col("top") == F.col("target"), F.lit(False)))
    return durable(graph.spark, rows.drop("top"), "guards")


def _occurrence(graph: Graph, rows: DataFrame) -> DataFrame:
    """``rows`` with ``found``: in the condition, a length call of the value, or else an identifier that stands for it;
    the last in order of id where there are several."""
    spots = _below(graph, rows.select("file", "guard", "value", "root").distinct(), "root", "node")
    named = graph.nodes.where("kind IN ('Call', 'Identifier')").select("file", F.col("id").alias("node"), "kind", "name")
    spots = durable(graph.spark, spots.join(named, ["file", "node"]), "guards")
    sites = graph.table("call_sites").groupBy("file", F.col("call_id").alias("node")).agg(F.max("callee").alias("callee"))
    calls = spots.where("kind = 'Call'").join(sites, ["file", "node"], "left").where(F.coalesce("callee", "name").isin(LENGTH_CALLS))
    calls = calls.join(arguments(graph, "Call").withColumnRenamed("call", "node"), ["file", "node"]).withColumn("place", F.explode("args"))
    plain = spots.where("kind = 'Identifier'").withColumn("place", F.col("node"))
    both = calls.select("file", "guard", "value", "node", "place", F.lit(1).alias("rank"))
    both = durable(graph.spark, both.unionByName(plain.select("file", "guard", "value", "node", "place", F.lit(0).alias("rank"))), "guards")
    known = occurrences(graph, rows, both.select("file", "value", "place"))
    best = both.join(known, ["file", "value", "place"], "left_semi").groupBy("file", "guard", "value").agg(F.max_by("node", F.struct("rank", "node")).alias("found"))
    return durable(graph.spark, rows.join(best, ["file", "guard", "value"], "left"), "guards")


def _comparison(graph: Graph, rows: DataFrame) -> DataFrame:
    """``rows`` with ``op``, the comparison nearest above ``found`` within the guard, read as value op bound on the
    branch taken, and its sides."""
    n = graph.nodes.where((F.col("kind") == "BinaryOp") & F.col("operator").isin("<", "<=", ">", ">=", "==", "!=") & (F.size("children") >= 2))
    n = n.select("file", F.col("id").alias("binop"), "operator", F.get("children", F.lit(0)).alias("left"), F.element_at("children", -1).alias("right"))
    found = rows.where("found IS NOT NULL").select("file", "guard", "found").distinct()
    # all that is asked below lies above what was found
    above = graph.ancestry.select("file", F.col("desc").alias("found"), "anc", "depth").join(found.select("file", "found").distinct(), ["file", "found"], "left_semi")
    above = durable(graph.spark, above, "guards")
    near = above.withColumnRenamed("anc", "binop").join(n, ["file", "binop"])
    # the comparison lies below the guard
    guard = above.select("file", "found", F.col("anc").alias("guard"), F.col("depth").alias("high"))
    cases = found.join(guard, ["file", "guard", "found"]).join(near, ["file", "found"]).where("depth < high")
    for name in ("left", "right"):
        held = above.select("file", "found", F.col("anc").alias(name), F.lit(True).alias("_held"))
        cases = cases.join(held, ["file", "found", name], "left")
        cases = cases.withColumn(f"in_{name}", (F.col(name) == F.col("found")) | F.coalesce("_held", F.lit(False))).drop("_held")
    cases = cases.where("in_left OR in_right")
    near = cases.groupBy("file", "guard", "found").agg(F.min_by(F.struct("operator", "left", "right", "in_left"), "depth").alias("c"))
    on_left = F.coalesce(F.col("c.in_left"), F.lit(False))
    op = F.when(on_left, F.col("c.operator")).otherwise(flipped(F.col("c.operator")))
    out = rows.join(near, ["file", "guard", "found"], "left").withColumn("op", F.when(F.col("then"), op).otherwise(opposite(op)))
    out = out.withColumns({"side": F.when(on_left, F.col("c.left")).otherwise(F.col("c.right")), "bound": F.when(on_left, F.col("c.right")).otherwise(F.col("c.left"))})
    return durable(graph.spark, out.drop("c"), "guards")


def _valued(graph: Graph, rows: DataFrame, node: str, out: str) -> DataFrame:
    values = graph.constants.select("file", F.col("node").alias(node), F.col("value").alias(out))
    return rows.join(values, ["file", node], "left")


def excludes_zero_by_joins(graph: Graph, asked: DataFrame) -> DataFrame:
    rows = _valued(graph, _comparison(graph, _occurrence(graph, _roots(graph, asked))), "bound", "bound_value")
    compared = F.coalesce(F.col("bound_value") == 0, F.lit(False)) & F.col("op").isNotNull()
    n = graph.nodes
    shape = n.select("file", "id", "kind", "node_type", "operator", F.get("children", F.lit(0)).alias("first"), F.element_at(F.when(F.size("children") > 0, F.col("children")), -1).alias("last"))

    def bare(rows: DataFrame, name: str) -> DataFrame:
        """Parentheses taken off the node ``name``, three at most, and its shape."""
        for i in range(4):
            own = shape.select("file", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "node_type", "operator", "first", "last")])
            rows = rows.join(own, ["file", name], "left")
            if i < 3:
                inner = F.when(F.col(f"{name}_node_type") == "parenthesized_expression", F.col(f"{name}_last"))
                rows = rows.withColumn(name, F.coalesce(inner, F.col(name))).drop(*[f"{name}_{c}" for c in ("kind", "node_type", "operator", "first", "last")])
        return rows

    rows = bare(rows, "root")
    negation = (F.col("root_kind") == "UnaryOp") & (F.col("root_operator") == "!")
    rows = rows.withColumn("inner", F.when(negation, F.col("root_first")).otherwise(F.col("root")))
    rows = durable(graph.spark, bare(rows, "inner").withColumn("no", F.coalesce(negation, F.lit(False))), "guards")
    places = rows.where("inner_kind = 'Identifier'").select("file", "value", F.col("inner").alias("place"))
    known = occurrences(graph, rows, places).select("file", "value", F.col("place").alias("inner"), F.lit(True).alias("stands"))
    rows = rows.join(known, ["file", "value", "inner"], "left")
    # a bare value holds on the branch taken, a negated one on the other
    plain = F.coalesce(F.col("stands"), F.lit(False)) & (F.col("no") != F.col("then"))
    return rows.where(F.when(compared, F.col("op") == "!=").otherwise(plain)).select(*ASKED).distinct()


def upper_bounds_by_joins(graph: Graph, asked: DataFrame) -> DataFrame:
    rows = _comparison(graph, _occurrence(graph, _roots(graph, asked))).where("op IN ('<', '<=')")
    rows = _valued(graph, rows, "bound", "bound_value")
    sums = graph.nodes.where((F.col("kind") == "BinaryOp") & F.col("operator").isin("+", "-") & (F.size("children") >= 2))
    sums = sums.select("file", F.col("id").alias("side"), F.col("operator").alias("sign"), F.get("children", F.lit(0)).alias("a"), F.element_at("children", -1).alias("b"))
    rows = rows.join(sums, ["file", "side"], "left")
    rows = _valued(graph, _valued(graph, rows, "a", "a_value"), "b", "b_value")
    plus = F.when(F.col("sign") == "+", F.col("b_value")).otherwise(-F.col("b_value"))
    offset = F.when(F.col("a") == F.col("found"), plus).when((F.col("b") == F.col("found")) & (F.col("sign") == "+"), F.col("a_value"))
    limit = F.col("capacity") + F.coalesce(offset, F.lit(0))
    within = F.when(F.col("op") == "<", F.col("bound_value") <= limit).otherwise(F.col("bound_value") < limit)
    free = (F.col("capacity") == UNKNOWN) | F.col("bound_value").isNull()
    return rows.where(free | within).select(*ASKED).distinct()


class _Function:
    """The tree, flows and constants of one function; ``whole`` if its nodes list children of its own only."""

    def __init__(self, given: list[dict]):
        self.nodes = {r["id"]: r for r in given if r["tag"] == "n"}
        self.asked = [(r["id"], r["a"], r["b"], int(r["text"])) for r in given if r["tag"] == "q"]
        self.callee = {r["id"]: r["name"] for r in given if r["tag"] == "s"}
        self.flows, self.below, self.lists = {}, {}, {}
        for r in given:
            if r["tag"] == "e" and r["id"] != r["a"]:
                self.flows.setdefault(r["id"], []).append(r["a"])
        for i, r in self.nodes.items():
            self.below.setdefault(r["a"], []).append(i)
            if r["node_type"] in ("argument_list", "arguments") and i < self.lists.get(r["a"], (i + 1,))[0]:
                self.lists[r["a"]] = i, r
        self.values = folded([r for r in self.nodes.values() if r["kind"] in VALUED or r["node_type"] == "parenthesized_expression"])
        self.whole = all(c is None or c in self.nodes for r in self.nodes.values() for c in r["children"])
        self._above, self._reached = {}, {}

    def above(self, i: int) -> dict[int, int]:
        """Strict ancestors and their depths."""
        if i not in self._above:
            out, p = {}, self.nodes[i]["a"]
            while p in self.nodes and p != i and p not in out and len(out) < 512:
                out[p] = len(out) + 1
                p = self.nodes[p]["a"]
            self._above[i] = out
        return self._above[i]

    def tree(self, top: int) -> list[int]:
        """The nodes at or below ``top``."""
        out, seen = [top], {top}
        for i in out:
            for c in self.below.get(i, ()):
                if c not in seen and top in self.above(c):
                    seen.add(c)
                    out.append(c)
        return out

    def reached(self, value: int) -> set[int] | None:
        """What flows from at or below the value reach, the seeds themselves included but the value; None if they
        leave the function."""
        if value not in self._reached:
            todo = self.tree(value)
            seen = set(todo)
            for i in todo:
                for c in self.flows.get(i, ()):
                    if c not in seen:
                        seen.add(c)
                        todo.append(c)
            self._reached[value] = seen - {value} if all(i in self.nodes for i in seen) else None
        return self._reached[value]

    def stands(self, value: int, place: int) -> bool:
        return place == value or not self.reached(value).isdisjoint(self.tree(place))

    def root(self, guard: int, target: int) -> tuple[int, bool]:
        r = self.nodes[guard]
        at, then = map(int, (r["fields"] or "0,0").split(","))
        child = lambda k: r["children"][k - 1] if 0 < k <= len(r["children"]) else None
        named, first, top = child(at), child(1), child(then)
        root = next(x for x in (named, first, guard) if x is not None)
        return root, top is not None and (top == target or top in self.above(target))

    def found(self, root: int, value: int) -> int | None:
        best = None
        for i in self.tree(root):
            r = self.nodes[i]
            if r["kind"] == "Identifier" and self.stands(value, i):
                best = max(best or (0, i), (0, i))
            callee = self.callee.get(i)
            if r["kind"] == "Call" and (r["name"] if callee is None else callee) in LENGTH_CALLS:
                _, inner = self.lists.get(i, (None, None))
                args = r["children"] if inner is None or inner["text"] is not None else inner["children"]
                if any(x is not None and self.stands(value, x) for x in args):
                    best = max(best or (1, i), (1, i))
        return None if best is None else best[1]

    def compared(self, guard: int, found: int | None, then: bool):
        """(op, side, bound) of the comparison nearest above ``found`` within the guard, read as side op bound."""
        if found is None:
            return None, None, None
        above = self.above(found)
        for i, depth in sorted(above.items(), key=lambda x: x[1]):
            r = self.nodes[i]
            if depth >= above.get(guard, 0) or r["kind"] != "BinaryOp" or r["operator"] not in FLIPPED or len(r["children"]) < 2:
                continue
            left, right = r["children"][0], r["children"][-1]
            on_left, on_right = (x == found or x in above for x in (left, right))
            if on_left or on_right:
                op = r["operator"] if on_left else FLIPPED[r["operator"]]
                return (op if then else OPPOSITE[op]), *((left, right) if on_left else (right, left))
        return None, None, None

    def bare(self, i: int | None) -> dict:
        """The node less its parentheses, three at most."""
        for _ in range(3):
            r = self.nodes.get(i, {})
            if r.get("node_type") == "parenthesized_expression" and r["children"] and r["children"][-1] is not None:
                i = r["children"][-1]
        return self.nodes.get(i, {})

    def nonzero(self, guard: int, value: int, target: int, capacity: int) -> bool:
        root, then = self.root(guard, target)
        op, _, bound = self.compared(guard, self.found(root, value), then)
        if op is not None and self.values.get(bound) == 0:
            return op == "!="
        r, no = self.bare(root), False
        if r["kind"] == "UnaryOp" and r["operator"] == "!":
            r, no = self.bare(r["children"][0] if r["children"] else None), True
        return r.get("kind") == "Identifier" and no != then and self.stands(value, r["id"])

    def bounded(self, guard: int, value: int, target: int, capacity: int) -> bool:
        root, then = self.root(guard, target)
        found = self.found(root, value)
        op, side, bound = self.compared(guard, found, then)
        if op not in ("<", "<="):
            return False
        limit, known = capacity, self.values.get(bound)
        r = self.nodes.get(side, {})
        if r.get("kind") == "BinaryOp" and r["operator"] in ("+", "-") and len(r["children"]) >= 2:
            a, b = r["children"][0], r["children"][-1]
            if a == found:
                limit += (self.values.get(b) or 0) * (1 if r["operator"] == "+" else -1)
            elif b == found and r["operator"] == "+":
                limit += self.values.get(a) or 0
        return capacity == UNKNOWN or known is None or (known <= limit if op == "<" else known < limit)


def _answered(graph: Graph, asked: DataFrame, test: Callable, joins: Callable) -> DataFrame:
    """The rows of ``asked`` that hold: by ``test`` where all they touch is in the guard's function, else by ``joins``."""
    asked = durable(graph.spark, asked.select(*ASKED).distinct(), "guards")
    n = graph.nodes
    inside = n.where("function_id IS NOT NULL")
    spot = inside.select("file", "id", F.col("function_id").alias("fn"))
    field = lambda name: F.coalesce(F.array_position("field_names", name), F.lit(0)).cast("string")
    words = ["kind", "node_type", "name", "operator", "lit_kind", "text", "fields"]
    # of texts only those that a test reads, so that functions that differ in others are equal
    rows = inside.select(
        "file", F.col("function_id").alias("fn"), F.lit("n").alias("tag"), "id", F.col("parent_id").alias("a"), "children", "kind", "node_type",
        F.when(F.col("kind") == "Call", F.col("name")).alias("name"), "operator", "lit_kind",
        F.when(F.col("kind") == "Literal", F.col("text")).when(F.col("children").isNull(), "").alias("text"),
        F.when(F.size("field_names") > 0, F.concat_ws(",", field("condition"), field("consequence"))).alias("fields"),
    )
    questions = asked.dropna().select("file", F.lit("q").alias("tag"), F.col("guard").alias("id"), F.col("value").alias("a"), F.col("target").alias("b"), F.col("capacity").cast("string").alias("text"))
    edges = graph.table("dfg_edges").select("file", F.lit("e").alias("tag"), F.col("src").alias("id"), F.col("dst").alias("a")).where("id <> a")
    sites = graph.table("call_sites").groupBy("file", F.col("call_id").alias("id")).agg(F.max("callee").alias("name")).withColumn("tag", F.lit("s"))
    for part in (questions, edges, sites):
        rows = rows.unionByName(part.join(spot, ["file", "id"]), allowMissingColumns=True)

    def run(given):
        f = _Function(given)
        out = [(r["a"], None, None, None, LEFT) for r in f.nodes.values() if r["a"] is not None and r["a"] not in f.nodes]
        for q in f.asked:
            _, value, target, _ = q
            held = OPEN if not f.whole or value not in f.nodes or target not in f.nodes or f.reached(value) is None else int(test(f, *q))
            out.append((*q, held))
        return out

    schema = "guard long, value long, target long, capacity long, said long"
    done = by_shape(rows, ["file", "fn"], run, schema, ["id", "a", "b"], "id", ["children"], ["tag", *words], ["guard", "value", "target"], ["tag", "a", "b", "text"])
    done = durable(graph.spark, done, "guards")
    free = n.where("function_id IS NULL AND parent_id IS NOT NULL").select("file", F.col("parent_id").alias("id"))
    settled = done.where(F.col("said") < OPEN)
    if settled.count() == asked.count() and done.where(F.col("said") == LEFT).isEmpty() and free.isEmpty():
        return settled.where(F.col("said") == HELD).select(*ASKED)
    left = done.where(F.col("said") == LEFT).select("file", F.col("guard").alias("id")).unionByName(free).distinct()
    settled = settled.join(left.join(spot, ["file", "id"]).select("file", "fn").distinct(), ["file", "fn"], "left_anti")
    settled = durable(graph.spark, settled.select(*ASKED, "said"), "guards")
    same = [asked[c].eqNullSafe(settled[c]) for c in ASKED]
    rest = durable(graph.spark, asked.join(settled, same, "left_anti"), "guards")
    return settled.where(F.col("said") == HELD).select(*ASKED).unionByName(joins(graph, rest))


def excludes_zero(graph: Graph, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` where the guard shows that the value isn't zero on the branch of the target: a comparison
    with a constant zero, or the bare value, maybe negated."""
    return _answered(graph, asked, _Function.nonzero, excludes_zero_by_joins)


def upper_bounds(graph: Graph, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` where the guard shows an upper bound of the value (or of its length, maybe plus or minus a
    constant) within the capacity; a bound or a capacity that isn't known is taken on trust."""
    return _answered(graph, asked, _Function.bounded, upper_bounds_by_joins)
