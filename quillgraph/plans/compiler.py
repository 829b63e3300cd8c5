"""Rules to DataFrame plans.

A clause's environment is one DataFrame with a struct column a binding.  The
planner places each conjunct at the first point where its variables are bound,
turns equalities of functions and identities into join keys, navigation into
left joins, relations and quantifiers into mark joins on the bound identities,
and inlines predicates.  All tests are two-valued: null equals null and nothing
else, orderings hold between integers only, and every leaf is true or false.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import language as L
from quillgraph.functions.kinds import kinds_of
from quillgraph.functions.language import RuleError
from quillgraph.operators import analyses, cfg, dfg, guards
from quillgraph.plans.graph import META, SCHEMAS, Graph

#: Node methods that read a column: type, column, value where it is null.
COLUMNS = {
    "name": ("str", "name", None), "text": ("str", "text", None), "raw_kind": ("str", "node_type", None),
    "kind": ("str", "kind", None), "namespace": ("str", "namespace", None), "class_context": ("str", "class_context", None),
    "visibility": ("str", "visibility", None), "operator": ("str", "operator", None), "line": ("int", "line", None),
    "end_line": ("int", "end_line", None), "file": ("str", "file", None), "arg_count": ("int", "argument_count", 0),
    "return_type": ("str", "signature", None), "lit_kind": ("str", "lit_kind", None), "string_value": ("str", "text", None),
    "is_constructor": ("bool", "is_constructor", False), "is_destructor": ("bool", "is_destructor", False),
    "is_virtual": ("bool", "is_virtual", False),
}
PAIR_FACTS = {"dominates": "dom", "post_dominates": "postdom", "cfg_reaches": "reach", "cfg_reaches_feasible": "reach"}
SELF_FACTS = {"in_loop": "loop", "loop_has_no_exit": "noexit", "in_exception_path": "exc"}
RELATIONS = {*PAIR_FACTS, *SELF_FACTS, "in_dead_branch", "same_block", "same_function", "dfg_flows_to", "dfg_reaches", "dfg_def", "dfg_use", "cfg_reaches_without"}
NODE_FIELDS = [f.name for f in SCHEMAS["nodes"]]


#: Kinds whose conditions guard what stands below them.
GUARDS = ["Conditional", "Loop", "Switch"]
#: Predicate calls that one clause may stand for.
MAX_CALLS = 10_000


class Value:
    """What an expression stands for: a node (its struct column), a scalar, or a constant; a size is an integer,
    or else the text of an expression (``text``); ``meta`` names a node's side table, ``name`` the column of a
    node that was navigated to."""

    def __init__(self, kind: str, column: Column | None = None, constant=None, text: Column | None = None, meta: str | None = None, name: str | None = None):
        self.kind, self.column, self.constant, self.text, self.meta, self.name = kind, column, constant, text, meta, name


def variables(e) -> set[str]:
    """Free variables of an expression."""
    if isinstance(e, L.Var):
        return {e.name}
    if isinstance(e, L.Method):
        return variables(e.of).union(*map(variables, e.args))
    if isinstance(e, L.Apply):
        return set().union(*map(variables, e.args))
    if isinstance(e, L.Compare):
        return variables(e.left) | variables(e.right)
    if isinstance(e, L.Logic):
        return set().union(*map(variables, e.parts))
    if isinstance(e, L.Quantified):
        return variables(e.body) - {e.var}
    if isinstance(e, L.Let):
        return variables(e.value) | (variables(e.body) - {e.var})
    if isinstance(e, L.Matches):
        return variables(e.of).union(*(variables(v) for _, v in e.fields))
    return set()


def rename(e, names: dict[str, object]):
    """The expression with variables replaced by expressions; inner bindings hide outer ones."""
    r = lambda x: rename(x, names)
    less = lambda v: {k: x for k, x in names.items() if k != v}
    if isinstance(e, L.Var):
        return names.get(e.name, e)
    if isinstance(e, L.Method):
        return L.Method(r(e.of), e.name, tuple(map(r, e.args)))
    if isinstance(e, L.Apply):
        return L.Apply(e.name, tuple(map(r, e.args)))
    if isinstance(e, L.Compare):
        return L.Compare(e.op, r(e.left), r(e.right))
    if isinstance(e, L.Logic):
        return L.Logic(e.op, tuple(map(r, e.parts)))
    if isinstance(e, L.Quantified):
        return L.Quantified(e.every, e.var, e.type, rename(e.body, less(e.var)))
    if isinstance(e, L.Let):
        return L.Let(e.var, r(e.value), rename(e.body, less(e.var)))
    if isinstance(e, L.Matches):
        return L.Matches(r(e.of), e.type, tuple((k, r(v)) for k, v in e.fields))
    return e


def negated(e, no: bool = True):
    """The negation of an expression (or, with ``no`` false, itself) with ``not`` moved inwards to where it
    meets a leaf, so that the parts of a negated disjunction can become join keys."""
    if isinstance(e, L.Logic):
        if e.op == "not":
            return negated(e.parts[0], not no)
        op = {"and": "or", "or": "and"}[e.op] if no else e.op
        parts = []
        for part in (negated(x, no) for x in e.parts):
            parts += part.parts if isinstance(part, L.Logic) and part.op == op else [part]
        return L.Logic(op, tuple(parts))
    if no and isinstance(e, L.Compare) and e.op in ("==", "!="):
        return L.Compare("!=" if e.op == "==" else "==", e.left, e.right)
    if no and isinstance(e, L.Quantified):
        return L.Quantified(not e.every, e.var, e.type, negated(e.body))
    return L.Logic("not", (e,)) if no else e


class Compiler:
    """Compiles clauses of one rule set over one graph."""

    def __init__(self, graph: Graph, rules: L.RuleSet, depth: int = 64):
        self.graph, self.rules, self.depth = graph, rules, depth
        self._fresh, self._calls = count(), 0
        #: Columns of the nodes that expressions stand for; a test that repeats an expression joins it once.
        self._nodes: dict[object, str] = {}

    # environments

    def candidates(self, var: str, type_: L.Type) -> DataFrame:
        nodes = self.graph.nodes
        if type_.raw is not None:
            nodes = nodes.where(F.col("node_type").isin(type_.raw, type_.raw.lower()))
        elif (kinds := kinds_of(type_.name)) is not None:
            nodes = nodes.where(F.col("kind").isin(kinds))
        return nodes.select("file", F.struct(*NODE_FIELDS).alias(var))

    def find(self, clause: L.Find) -> DataFrame:
        """One row for each binding of the clause's variables that satisfies it."""
        where = self.inline(clause.where)
        tests = list(where.parts) if isinstance(where, L.Logic) and where.op == "and" else [where]
        names = [v for v, _ in clause.bindings]
        if len(set(names)) < len(names):
            raise RuleError("a variable is bound twice")
        for t in tests:
            if extra := variables(t) - set(names):
                raise RuleError(f"undefined variable {sorted(extra)[0]!r}")
        sides = {}
        for var, type_ in clause.bindings:
            env = self.candidates(var, type_)
            for t in [t for t in tests if variables(t) <= {var}]:
                env = self.keep(env, t, {var})
                tests.remove(t)
            sides[var] = env
        env, bound = sides[names[0]], {names[0]}
        for var in names[1:]:
            env, met = self.join(env, sides[var], bound, var, [t for t in tests if var in variables(t) and variables(t) <= bound | {var}])
            tests = [t for t in tests if t is not met]
            bound.add(var)
            for t in [t for t in tests if variables(t) <= bound]:
                env = self.keep(env, t, bound)
                tests.remove(t)
        return env.select("file", *names)

    def join(self, env: DataFrame, side: DataFrame, bound: set[str], var: str, tests: list) -> tuple[DataFrame, object]:
        """Equi-join on the file and every key that the tests imply between ``var`` and what is bound; and the test of
        ancestry that the join has met, if any.  Of ancestry and a function the pairs of ancestors are joined: a function
        has many more pairs of nodes than that."""
        on = []
        ancestors = met = None
        for t in tests:
            match t:
                case L.Method(L.Var(a), name, (L.Var(b),)) if name in {"same_function", *PAIR_FACTS, "same_block"} and var in (a, b) and a != b:
                    # control-flow relations hold inside one function only
                    on.append(F.col(f"{a}.function_id") == F.col(f"{b}.function_id"))
                case L.Compare("==", L.Method(L.Var(a), "id", ()), L.Method(L.Var(b), "id", ())) if var in (a, b) and a != b:
                    on.append(F.col(f"{a}.id") == F.col(f"{b}.id"))
                case L.Method(L.Var(low), "has_ancestor", (L.Method(L.Var(high), "id", ()),)) if var in (low, high) and low != high:
                    ancestors, met = ancestors or (low, high), met or t
        side = side.withColumnRenamed("file", "_file")
        if ancestors is None:
            return env.join(side, [F.col("file") == F.col("_file"), *on]).drop("_file"), None
        low, high = ancestors
        pairs = self.graph.ancestry.select(F.col("file").alias("_f"), "anc", "desc")
        known, other = (low, "desc") if low in bound else (high, "anc"), (high, "anc") if low in bound else (low, "desc")
        env = env.join(pairs, (F.col("file") == F.col("_f")) & (F.col(f"{known[0]}.id") == F.col(known[1])))
        on = [F.col("_f") == F.col("_file"), F.col(f"{other[0]}.id") == F.col(other[1]), *on]
        return env.join(side, on).drop("_file", "_f", "anc", "desc"), met

    def keep(self, env: DataFrame, test, bound: set[str]) -> DataFrame:
        columns = env.columns
        env, ok = self.truth(env, test, bound)
        return env.where(ok).select(*columns)

    def inline(self, e, within: tuple = ()):
        """Predicates replaced by their bodies, wherever they stand; an unknown one is false.  A call that comes
        back to itself with the same arguments adds nothing to a least fixpoint and is false as well, and so is
        recursion past the bound."""
        if isinstance(e, L.Apply):
            d = self.rules.definitions.get(e.name)
            if d is None or d.role != "pred" or len(within) > self.depth or len(d.params) != len(e.args) or e in within:
                return L.Lit(False)
            self._calls += 1
            if self._calls > MAX_CALLS:
                raise RuleError(f"predicate {e.name!r} unfolds to more than {MAX_CALLS} calls")
            names = dict(zip([v for v, _ in d.params], e.args, strict=True))
            return self.inline(rename(d.body, names), (*within, e))
        r = lambda x: self.inline(x, within)
        if isinstance(e, L.Logic):
            return L.Logic(e.op, tuple(map(r, e.parts)))
        if isinstance(e, L.Quantified):
            return L.Quantified(e.every, e.var, e.type, r(e.body))
        if isinstance(e, L.Let):
            return L.Let(e.var, r(e.value), r(e.body))
        if isinstance(e, L.Compare):
            return L.Compare(e.op, r(e.left), r(e.right))
        if isinstance(e, L.Method):
            return L.Method(r(e.of), e.name, tuple(map(r, e.args)))
        if isinstance(e, L.Matches):
            return L.Matches(r(e.of), e.type, tuple((k, r(v)) for k, v in e.fields))
        return e

    # truth

    def truth(self, env: DataFrame, e, bound: set[str]) -> tuple[DataFrame, Column]:
        if isinstance(e, L.Logic):
            out = None
            for part in e.parts:
                env, c = self.truth(env, part, bound)
                out = c if out is None else (out & c if e.op == "and" else out | c)
            return env, ~out if e.op == "not" else out
        if isinstance(e, L.Lit):
            return env, F.lit(e.value is not None and e.value is not False and e.value != 0)
        if isinstance(e, L.Var):
            return env, F.col(f"{e.name}.id").isNotNull()
        if isinstance(e, L.Quantified):
            body = negated(e.body, e.every)
            outer, self._nodes = self._nodes, {}
            env, some = self.exists(env, e.var, e.type, body, bound)
            self._nodes = outer
            return env, ~some if e.every else some
        if isinstance(e, L.Let):
            env, v = self.value(env, e.value, bound)
            if v.kind != "node":
                return env, F.lit(False)
            env = env.withColumn(e.var, v.column)
            # the name may have stood for another node
            outer, self._nodes = self._nodes, {}
            env, body = self.truth(env, e.body, bound | {e.var})
            self._nodes = outer
            return env, F.col(f"{e.var}.id").isNotNull() & body
        if isinstance(e, L.Matches):
            return self.matches(env, e, bound)
        if isinstance(e, L.Compare):
            env, left = self.value(env, e.left, bound)
            if isinstance(e.right, (L.Pattern, L.Many)):
                return env, self.member(left, e.right)
            env, right = self.value(env, e.right, bound)
            return env, self.compare(e.op, left, right)
        env, v = self.value(env, e, bound)
        return env, F.coalesce(v.column, F.lit(False)) if v.kind == "bool" else F.lit(False)

    def compare(self, op: str, a: Value, b: Value) -> Column:
        ident = lambda v: v.column["id"] if v.kind == "node" else v.column
        # a size that is a text is compared with texts
        a, b = (Value("str", x.text) if x.text is not None and y.kind == "str" else x for x, y in ((a, b), (b, a)))
        if op in ("==", "!="):
            if "null" in (a.kind, b.kind):
                other = a if b.kind == "null" else b
                same = F.lit(True) if other.kind == "null" else ident(other).isNull()
                if other.text is not None:
                    same = same & other.text.isNull()
            elif a.kind == b.kind:
                same = ident(a).eqNullSafe(ident(b))
            else:
                # of different types only nulls are equal
                same = ident(a).isNull() & ident(b).isNull()
            return ~same if op == "!=" else same
        if op == "in":
            return F.coalesce(b.column.contains(a.column), F.lit(False)) if a.kind == b.kind == "str" else F.lit(False)
        if a.kind != "int" or b.kind != "int":
            return F.lit(False)
        x, y = a.column, b.column
        return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))

    def member(self, a: Value, right) -> Column:
        if isinstance(right, L.Pattern):
            try:
                re.compile(right.body)
            except re.error:
                return F.lit(False)
            if re.search(r"\(\?[=!<]|\\[1-9]", right.body):
                raise RuleError("look-around and back-references are not part of the pattern language")
            flags = "".join(f for f in "ism" if f in right.flags)
            return F.coalesce(a.column.rlike((f"(?{flags})" if flags else "") + right.body), F.lit(False)) if a.kind == "str" else F.lit(False)
        out = F.lit(False)
        for x in right.items:
            out = out | self.compare("==", a, self.literal(x))
        return out

    def matches(self, env: DataFrame, e: L.Matches, bound: set[str]) -> tuple[DataFrame, Column]:
        env, v = self.value(env, e.of, bound)
        if v.kind != "node":
            return env, F.lit(False)
        out = v.column["id"].isNotNull()
        if e.type.raw is not None:
            out = out & F.coalesce(v.column["node_type"].isin(e.type.raw, e.type.raw.lower()), F.lit(False))
        elif (kinds := kinds_of(e.type.name)) is not None:
            out = out & F.coalesce(v.column["kind"].isin(kinds), F.lit(False))
        for name, wanted in e.fields:
            kind, column, _ = COLUMNS.get(name, ("null", None, None))
            own = Value(kind, v.column[column] if column else F.lit(None).cast("string"))
            if isinstance(wanted, (L.Pattern, L.Many)):
                out = out & self.member(own, wanted)
            else:
                env, w = self.value(env, wanted, bound)
                out = out & self.compare("==", own, w)
        return env, out

    def exists(self, env: DataFrame, var: str, type_: L.Type, body, bound: set[str]) -> tuple[DataFrame, Column]:
        """Mark join: whether some node of the type in the file satisfies the body."""
        used = sorted(variables(body) & bound - {var})
        keys = [F.col("file"), *[F.col(f"{v}.id").alias(f"_k{i}") for i, v in enumerate(used)]]
        # only what the body speaks of: outer rows that agree in it are asked once
        outer = env.select("file", *used).dropDuplicates(["file"]) if not used else env.select("file", *used)
        tests = list(body.parts) if isinstance(body, L.Logic) and body.op == "and" else [body]
        side = self.candidates(var, type_)
        for t in [t for t in tests if variables(t) <= {var}]:
            side = self.keep(side, t, {var})
            tests.remove(t)
        linked = [t for t in tests if var in variables(t)]
        inner, met = self.join(outer, side, set(used), var, linked)
        for t in [t for t in tests if t is not met]:
            inner = self.keep(inner, t, {*used, var})
        mark = f"_m{next(self._fresh)}"
        hits = inner.select(*keys).distinct().withColumn(mark, F.lit(True))
        names = [f"{mark}{i}" for i in range(len(used) + 1)]
        hits = hits.toDF(*names, mark)
        on = [F.col("file") == F.col(names[0]), *[F.col(f"{v}.id").eqNullSafe(F.col(n)) for v, n in zip(used, names[1:], strict=True)]]
        return env.join(hits, on, "left").drop(*names), F.coalesce(F.col(mark), F.lit(False))

    # values

    @staticmethod
    def literal(e) -> Value:
        x = e.value if isinstance(e, L.Lit) else None
        if x is None or isinstance(x, float):
            return Value("null", F.lit(None).cast("string"))
        return Value("bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "str", F.lit(x), x)

    def value(self, env: DataFrame, e, bound: set[str]) -> tuple[DataFrame, Value]:
        if isinstance(e, L.Lit):
            return env, self.literal(e)
        if isinstance(e, L.Var):
            if e.name not in bound:
                raise RuleError(f"undefined variable {e.name!r}")
            return env, Value("node", F.col(e.name))
        if isinstance(e, L.Method):
            if e.name in RELATIONS:
                return self.relation(env, e, bound)
            if self._nodes.get(e) in env.columns:
                return env, Value("node", F.col(self._nodes[e]))
            env, of = self.value(env, e.of, bound)
            if of.meta is not None:
                return self.side_table(env, of, e.name)
            if of.kind != "node":
                return env, Value("null", F.lit(None).cast("string"))
            env, v = self.method(env, of.column, e, bound)
            if v.name is not None:
                self._nodes[e] = v.name
            return env, v
        if isinstance(e, (L.Pattern, L.Many, L.Apply)):
            raise RuleError("a pattern or a list stands only after 'in'")
        env, c = self.truth(env, e, bound)
        return env, Value("bool", c)

    def step(self, env: DataFrame, node: Column, ident: Column) -> tuple[DataFrame, Value]:
        """The node of the same file with the given id, or null."""
        name = f"_n{next(self._fresh)}"
        nodes = self.graph.nodes.select(F.col("file").alias(f"{name}f"), F.col("id").alias(f"{name}i"), F.struct(*NODE_FIELDS).alias(name))
        env = env.withColumn(f"{name}k", ident)
        env = env.join(nodes, (F.col("file") == F.col(f"{name}f")) & (F.col(f"{name}k") == F.col(f"{name}i")), "left")
        return env.drop(f"{name}f", f"{name}i", f"{name}k"), Value("node", F.col(name), name=name)

    def method(self, env: DataFrame, node: Column, e: L.Method, bound: set[str]) -> tuple[DataFrame, Value]:
        name = e.name
        if name in COLUMNS:
            kind, column, default = COLUMNS[name]
            c = node[column]
            if default is not None:
                c = F.when(node["id"].isNotNull(), F.coalesce(c, F.lit(default).cast("long" if kind == "int" else "boolean")))
            return env, Value(kind, c)
        if name == "is_some":
            return env, Value("bool", node["id"].isNotNull())
        if name == "is_none":
            return env, Value("bool", F.lit(False))
        if name in ("id", "return_value"):
            return env, Value("node", node)
        if name == "int_value":
            number = F.when(node["text"].rlike(r"^[+-]?[0-9]+$"), node["text"].try_cast("bigint"))
            return env, Value("int", number)
        if name in ("base_classes", "implements"):
            return env, Value("str", F.get(node["base_classes"], F.lit(0)))
        if name in ("callee_name", "qualified_callee", "callee_kind"):
            return self.call_site(env, node, name)
        first = e.args[0] if e.args else None
        at = first.value if isinstance(first, L.Lit) and isinstance(first.value, int) else 0
        if name == "parent":
            return self.step(env, node, node["parent_id"])
        if name == "function_id":
            return self.step(env, node, node["function_id"])
        if name == "child":
            return self.step(env, node, F.get(node["children"], F.lit(at)))
        if name in ("children", "receiver"):
            return self.step(env, node, F.get(node["children"], F.lit(0)))
        if name == "arg":
            return self.argument(env, node, at)
        if name in ("ancestor", "descendant"):
            return self.nearest(env, node, first.value if isinstance(first, L.Lit) else None, name)
        if name in ("has_ancestor", "has_descendant"):
            return self.related(env, node, first, name, bound)
        if name == "has_arg":
            env, other = self.value(env, first, bound)
            return env, Value("bool", F.array_contains(node["children"], other.column["id"]))
        if name == "refers_to":
            return self.declaration(env, node)
        if name.endswith("_meta") and name[:-5] in META:
            return env, Value("node", node, meta=name[:-5])
        if name in ("eval_int", "eval_bool", "is_const_expr"):
            env, v = self.look(env, self.graph.constants, [(node["id"], "node")], "value")
            return env, Value("int", v) if name == "eval_int" else Value("bool", v != 0 if name == "eval_bool" else v.isNotNull())
        if name in ("alloc_size", "has_known_size"):
            sizes = self.graph.sizes.withColumn("size", F.struct("size_int", "size_expr"))
            env, v = self.look(env, sizes, [(node["id"], "node")], "size")
            return env, Value("bool", v["size_int"].isNotNull()) if name == "has_known_size" else Value("int", v["size_int"], text=v["size_expr"])
        if name in ("may_be_null", "null_source"):
            env, source = self.look(env, self.graph.nullability, [(node["id"], "node")], "source")
            return (env, Value("bool", source.isNotNull())) if name == "may_be_null" else self.step(env, node, source)
        if name in ("points_to", "alias_target", "is_pointer"):
            targets = analyses.points_to(self.graph).groupBy("file", "pointer").agg(F.min("target").alias("target"))
            env, target = self.look(env, targets, [(node["id"], "pointer")], "target")
            return (env, Value("bool", target.isNotNull())) if name == "is_pointer" else self.step(env, node, target)
        if name in ("param", "param_count"):
            env, own = self.look(env, analyses.parameters(self.graph), [(node["id"], "fn")], "params")
            if name == "param":
                return self.step(env, node, F.get(own, F.lit(at)))
            return env, Value("int", F.when(node["id"].isNotNull(), F.coalesce(F.size(own), F.lit(0)).cast("long")))
        if name == "basic_block":
            env, place = self.look(env, self.placed(), [(node["id"], "node")], "place")
            return env, Value("int", place["block"])
        if name in ("branch_condition", "loop_condition", "guard_evals_true", "guard_evals_false"):
            kinds = {"branch_condition": ["Conditional", "Switch"], "loop_condition": ["Loop"]}.get(name, GUARDS)
            env, condition = self.look(env, analyses.guarding(self.graph, kinds), [(node["id"], "desc")], "condition")
            if name.endswith("condition"):
                return self.step(env, node, condition)
            env, v = self.look(env, self.graph.constants, [(condition, "node")], "value")
            return env, Value("bool", F.coalesce(v != 0 if name == "guard_evals_true" else v == 0, F.lit(False)))
        if name in ("excludes_zero", "bounds_value"):
            return self.guard(env, node, e, bound)
        raise RuleError(f"unknown method {name!r}")

    def mark(self, env: DataFrame, right: DataFrame, on: list[tuple[Column, str]]) -> tuple[DataFrame, Value]:
        """Whether (file, keys) is among the distinct rows of ``right``."""
        tag = f"_r{next(self._fresh)}"
        names = [f"{tag}{i}" for i in range(len(on) + 1)]
        right = right.select("file", *[c for _, c in on]).distinct().toDF(*names).withColumn(tag, F.lit(True))
        keyed = [F.col("file") == F.col(names[0]), *[c == F.col(n) for (c, _), n in zip(on, names[1:], strict=True)]]
        return env.join(right, keyed, "left").drop(*names), Value("bool", F.coalesce(F.col(tag), F.lit(False)))

    def look(self, env: DataFrame, right: DataFrame, on: list[tuple[Column, str]], out: str) -> tuple[DataFrame, Column]:
        """Column ``out`` of ``right``, which has one row a (file, keys), or null."""
        tag = f"_l{next(self._fresh)}"
        names = [f"{tag}{i}" for i in range(len(on) + 1)]
        right = right.select("file", *[c for _, c in on], out).toDF(*names, tag)
        keyed = [F.col("file") == F.col(names[0]), *[c == F.col(n) for (c, _), n in zip(on, names[1:], strict=True)]]
        return env.join(right, keyed, "left").drop(*names), F.col(tag)

    def side_table(self, env, of: Value, field: str):
        """A field of a language's side table; of a list its first entry; null where the node has no row."""
        name = f"meta_{of.meta}"
        if field not in SCHEMAS[name].fieldNames():
            return env, Value("null", F.lit(None).cast("string"))
        rows = self.graph.table(name).select("file", "id", field, F.lit(True).alias("here"))
        rows = rows.groupBy("file", "id").agg(F.max(F.struct("here", field)).alias("row"))
        env, row = self.look(env, rows, [(of.column["id"], "id")], "row")
        type_ = SCHEMAS[name][field].dataType.simpleString()
        if type_ == "boolean":
            return env, Value("bool", F.when(row["here"], F.coalesce(row[field], F.lit(False))))
        return env, Value("str", F.get(row[field], F.lit(0)) if type_.startswith("array") else row[field])

    def guard(self, env, node, e, bound):
        """excludes_zero(value, target) and bounds_value(value, target, capacity) of the guard ``node``."""
        columns = []
        for x in e.args[:2]:
            env, v = self.value(env, x, bound)
            columns.append(v)
        if len(columns) < 2 or any(v.kind != "node" for v in columns):
            return env, Value("bool", F.lit(False))
        capacity = F.lit(None).cast("long")
        if e.name == "bounds_value" and len(e.args) > 2:
            env, v = self.value(env, e.args[2], bound)
            if v.kind == "int":
                capacity = v.column.cast("long")
            elif v.kind == "node":
                # a node's own size, or that of the declaration it refers to
                env, own = self.look(env, self.graph.sizes, [(v.column["id"], "node")], "size_int")
                env, other = self.declaration(env, v.column)
                env, theirs = self.look(env, self.graph.sizes, [(other.column["id"], "node")], "size_int")
                capacity = F.coalesce(own, theirs)
        tag = f"_g{next(self._fresh)}"
        asked = [node["id"], columns[0].column["id"], columns[1].column["id"]]
        env = env.withColumn(f"{tag}c", F.coalesce(capacity, F.lit(guards.UNKNOWN)))
        seeds = env.select("file", *[c.alias(n) for c, n in zip(asked, ("guard", "value", "target"), strict=True)], F.col(f"{tag}c").alias("capacity"))
        held = (guards.excludes_zero if e.name == "excludes_zero" else guards.upper_bounds)(self.graph, seeds.distinct())
        env, ok = self.mark(env, held, [*zip(asked, ("guard", "value", "target"), strict=True), (F.col(f"{tag}c"), "capacity")])
        return env, ok

    def call_site(self, env, node, name):
        sites = self.graph.table("call_sites").groupBy("file", "call_id").agg(
            F.max_by(F.struct("callee", "qualified_callee", "callee_kind"), F.struct("caller_fn", "callee")).alias("s")
        )
        env, s = self.look(env, sites, [(node["id"], "call_id")], "s")
        if name == "callee_kind":
            return env, Value("str", F.when(node["id"].isNotNull(), F.coalesce(s["callee_kind"], F.lit("unknown"))))
        own = F.coalesce(s["callee"], node["name"])
        return env, Value("str", F.coalesce(s["qualified_callee"], own) if name == "qualified_callee" else own)

    def argument(self, env, node, at):
        n = self.graph.nodes
        lists = n.where(F.col("node_type").isin("argument_list", "arguments")).groupBy("file", "parent_id").agg(
            F.get(F.min_by("children", "id"), F.lit(at)).alias("arg")
        )
        env, inner = self.look(env, lists, [(node["id"], "parent_id")], "arg")
        return self.step(env, node, F.coalesce(inner, F.get(node["children"], F.lit(at))))

    def nearest(self, env, node, wanted, name):
        up = name == "ancestor"
        own, other = ("desc", "anc") if up else ("anc", "desc")
        pairs = self.graph.ancestry
        if wanted is not None:
            low = wanted.lower()
            fit = self.graph.nodes.where((F.lower("node_type") == low) | (F.lower("kind") == low)).select("file", F.col("id").alias(other))
            pairs = pairs.join(fit, ["file", other], "left_semi")
        near = pairs.groupBy("file", own).agg(F.min_by(other, F.struct("depth", other)).alias("hit"))
        env, hit = self.look(env, near, [(node["id"], own)], "hit")
        return self.step(env, node, hit)

    def related(self, env, node, first, name, bound):
        own, other = ("desc", "anc") if name == "has_ancestor" else ("anc", "desc")
        pairs = self.graph.ancestry
        if first is None:
            return self.mark(env, pairs, [(node["id"], own)])
        if isinstance(first, L.Lit):
            low = str(first.value).lower()
            fit = self.graph.nodes.where((F.lower("node_type") == low) | (F.lower("kind") == low)).select("file", F.col("id").alias(other))
            return self.mark(env, pairs.join(fit, ["file", other], "left_semi"), [(node["id"], own)])
        env, v = self.value(env, first, bound)
        if v.kind != "node":
            return env, Value("bool", F.lit(False))
        return self.mark(env, pairs, [(node["id"], own), (v.column["id"], other)])

    def declaration(self, env, node):
        n = self.graph.nodes.where(F.col("kind").isin("LocalDef", "ParamDef", "FieldDef", "MethodDef")).where("name IS NOT NULL")
        local = n.groupBy("file", "function_id", "name").agg(F.min("id").alias("hit"))
        anywhere = n.groupBy("file", "name").agg(F.min("id").alias("hit"))
        called = self.graph.table("call_sites").groupBy("file", "call_id").agg(F.max("callee_id").alias("hit"))
        word = F.coalesce(node["name"], node["text"])
        env, a = self.look(env, called, [(node["id"], "call_id")], "hit")
        env, b = self.look(env, local, [(node["function_id"], "function_id"), (word, "name")], "hit")
        # the file is searched for what its function lacks; other rows are dealt by their ids, not all of a word to one task
        lacks = F.coalesce(a.isNull() & b.isNull() & (node["kind"] == "Identifier"), F.lit(False))
        spread = F.when(lacks, F.lit(0).cast("long")).otherwise(node["id"])
        env, c = self.look(env, anywhere.withColumn("spread", F.lit(0).cast("long")), [(F.when(lacks, word), "name"), (spread, "spread")], "hit")
        return self.step(env, node, F.coalesce(a, F.when(node["kind"] == "Identifier", F.coalesce(b, c))))

    # relations between bound nodes

    def placed(self) -> DataFrame:
        """(file, node, place): the function and block of each node that has one."""
        own = self.graph.table("block_nodes").groupBy("file", F.col("node_id").alias("node"))
        return own.agg(F.max(F.struct("function", F.col("block_ord").alias("block"))).alias("place"))

    def relation(self, env: DataFrame, e: L.Method, bound: set[str]) -> tuple[DataFrame, Value]:
        names = [e.of, *[a for a in e.args if not (e.name in ("dfg_def", "dfg_use"))]]
        if not all(isinstance(x, L.Var) and x.name in bound for x in names):
            raise RuleError(f"{e.name} relates bound variables only")
        ids = [F.col(f"{x.name}.id") for x in names]
        if e.name == "same_function":
            a, b = (F.col(f"{x.name}.function_id") for x in names)
            return env, Value("bool", F.coalesce(a == b, F.lit(False)))
        if e.name in ("dfg_def", "dfg_use"):
            label = e.args[0].name if isinstance(e.args[0], L.Var) else e.args[0].value
            return self.mark(env, dfg.labelled(self.graph, "src" if e.name == "dfg_def" else "dst", label), [(ids[0], "a")])
        if e.name == "dfg_flows_to":
            return self.mark(env, dfg.flows_to(self.graph), [(ids[0], "a"), (ids[1], "b")])
        if e.name == "dfg_reaches":
            seeds = env.select("file", ids[0].alias("a")).distinct()
            return self.mark(env, dfg.reaches(self.graph, seeds), [(ids[0], "a"), (ids[1], "b")])
        # nodes stand for their blocks, and facts are asked by block
        places = []
        for i in ids:
            env, place = self.look(env, self.placed(), [(i, "node")], "place")
            name = f"_b{next(self._fresh)}"
            env = env.withColumn(name, place)
            places.append(F.col(name))
        one = places[0]
        together = F.lit(True)
        for other in places[1:]:
            together = together & F.coalesce(other["function"] == one["function"], F.lit(False))
        if e.name == "same_block":
            return env, Value("bool", together & F.coalesce(places[1]["block"] == one["block"], F.lit(False)))
        function = (one["function"], "function")
        if e.name == "cfg_reaches_without":
            # a barrier without a block of this function bars nothing
            barrier = f"_w{next(self._fresh)}"
            env = env.withColumn(barrier, F.when(places[2]["function"] == one["function"], places[2]["block"]).otherwise(F.lit(-1).cast("long")))
            where = env.where(one.isNotNull()).select("file", function[0].alias("function"), one["block"].alias("a"), F.col(barrier).alias("barrier"))
            hit = cfg.reach_without(self.graph.spark, self.graph.table("cfg_edges"), where)
            env, ok = self.mark(env, hit, [function, (one["block"], "a"), (F.col(barrier), "barrier"), (places[1]["block"], "b")])
            return env, Value("bool", ok.column & F.coalesce(places[1]["function"] == one["function"], F.lit(False)))
        if e.name == "in_dead_branch":
            entry = self.graph.table("blocks").groupBy("file", "function").agg(F.min("block_ord").alias("a"))
            live = self.graph.feasible_facts.where("fact = 'reach'").join(entry, ["file", "function", "a"]).select("file", "function", "b")
            env, ok = self.mark(env, live, [function, (one["block"], "b")])
            return env, Value("bool", one.isNotNull() & ~ok.column)
        if e.name in SELF_FACTS:
            facts = self.graph.flow_facts.where(F.col("fact") == SELF_FACTS[e.name]).select("file", "function", "a")
            if e.name == "loop_has_no_exit":
                # a constant true condition in the header closes the exit as well
                closed = analyses.block_conditions(self.graph).where("value <> 0").select("file", "function", F.col("src").alias("b"))
                loops = self.graph.flow_facts.where("fact = 'loop'").select("file", "function", "a", "b")
                facts = facts.unionByName(loops.join(closed, ["file", "function", "b"], "left_semi").drop("b"))
            return self.mark(env, facts, [function, (one["block"], "a")])
        facts = self.graph.feasible_facts if e.name == "cfg_reaches_feasible" else self.graph.flow_facts
        facts = facts.where(F.col("fact") == PAIR_FACTS[e.name]).select("file", "function", "a", "b")
        env, ok = self.mark(env, facts, [function, (one["block"], "a"), (places[1]["block"], "b")])
        return env, Value("bool", ok.column & together)


def finding(rule: L.Rule, env: DataFrame, names: list[str]) -> DataFrame:
    """The findings of one find clause: located at the first binding; matched nodes in order of binding."""
    at = F.col(names[0])
    return env.select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"),
        F.array(*[F.lit(t) for t in rule.tags]).cast("array<string>").alias("tags"), "file", at["line"].alias("line"),
        at["end_line"].alias("end_line"), at["column"].alias("column"), at["end_column"].alias("end_column"),
        F.array(*[F.col(f"{v}.id") for v in names]).alias("matched_nodes"),
    )


def run_rules(graph: Graph, rules: L.RuleSet | str, registry=None) -> DataFrame:
    """The findings of all rules."""
    from quillgraph.operators.taint import run_clause

    rules = L.parse(rules) if isinstance(rules, str) else rules
    out = None
    for rule in rules.rules:
        own = graph
        if rule.languages is not None:
            own = graph.only(nodes=graph.nodes.where(F.col("lang").isin(rule.languages)))
        compiler = Compiler(own, rules)
        for clause in rule.clauses:
            if isinstance(clause, L.Find):
                part = finding(rule, compiler.find(clause), [v for v, _ in clause.bindings])
            else:
                part = run_clause(compiler, rule, clause, registry)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise RuleError("no rule has a clause")
    return out
