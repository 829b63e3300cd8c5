"""The pass over functions against the joins it stands for."""

import random

from quillgraph.operators import guards
from quillgraph.operators.analyses import conditions, guarding
from quillgraph.plans.graph import Graph

NODES = "file string, id long, kind string, node_type string, name string, text string, parent_id long, function_id long, operator string, lit_kind string, children array<long>, field_names array<string>"


def function(r, file, first, lost):
    """Nodes, flows and questions of a made-up function with ids from ``first`` on."""
    nodes, flows, asked, guards_ = {}, [], [], []
    n = iter(range(first, first + 200))

    def add(parent, kind, **more):
        i = next(n)
        nodes[i] = {"file": file, "id": i, "kind": kind, "node_type": kind.lower(), "parent_id": parent, "function_id": first, "children": [], "name": None, "text": None, "operator": None, "lit_kind": None, "field_names": None} | more
        if parent is not None:
            nodes[parent]["children"].append(i)
        return i

    def expression(parent, depth):
        pick = r.random()
        if depth and pick < 0.4:
            b = add(parent, "BinaryOp", operator=r.choice(["<", "<=", ">", ">=", "==", "!=", "+", "-", "&&"]))
            expression(b, depth - 1), expression(b, depth - 1)
        elif depth and pick < 0.5:
            expression(add(parent, "UnaryOp", operator=r.choice("!-")), depth - 1)
        elif depth and pick < 0.6:
            expression(add(parent, "Paren", node_type="parenthesized_expression"), depth - 1)
        elif depth and pick < 0.7:
            c = add(parent, "Call", name=r.choice(["strlen", "f"]))
            expression(add(c, "Args", node_type="argument_list") if r.random() < 0.5 else c, 0)
        elif pick < 0.85:
            add(parent, "Identifier", text="a")
        else:
            add(parent, "Literal", lit_kind="Int", text=str(r.choice([0, 0, 1, 7])))

    top = add(None, "MethodDef")
    values = [add(top, "ParamDef", name=x) for x in "ab"]
    for _ in range(3):
        g = add(top, "Conditional")
        guards_.append(g)
        expression(g, r.randrange(4))
        b = add(g, "Block")
        add(b, "Call", name="use")
        nodes[g]["field_names"] = r.choice([["condition", "consequence"], ["condition", "consequence"], None])
    names = [i for i, x in nodes.items() if x["kind"] == "Identifier"]
    for i in names:
        if r.random() < 0.7:
            flows.append((file, r.choice(values), i))
    if lost == "flow":
        flows += [(file, values[0], first + 100_000), (file, first + 100_000, names[0] if names else values[1])]
    if lost == "child":
        inner = add(r.choice(guards_), "MethodDef")
        nodes[inner]["function_id"] = inner
    uses = [i for i, x in nodes.items() if x["name"] == "use"]
    asked = [(file, g, v, u, c) for g in guards_ for v in values for u in uses for c in (guards.UNKNOWN, 1, 6)]
    return list(nodes.values()), flows, asked


def test_pass_equals_joins(spark):
    r = random.Random(5)
    made = [function(r, f"f{k % 3}", 1000 * k + 7, {5: "flow", 6: "child"}.get(k % 10)) for k in range(160)]
    nodes, flows, asked = ([x for m in made for x in m[i]] for i in range(3))
    columns = [c.split()[0] for c in NODES.split(", ")]
    graph = Graph(spark, {
        "nodes": spark.createDataFrame([tuple(x[c] for c in columns) for x in nodes], NODES),
        "dfg_edges": spark.createDataFrame(flows, "file string, src long, dst long"),
    }).written()
    asked = spark.createDataFrame(asked, "file string, guard long, value long, target long, capacity long")
    for own, joins in ((guards.excludes_zero, guards.excludes_zero_by_joins), (guards.upper_bounds, guards.upper_bounds_by_joins)):
        got, want = {tuple(x) for x in own(graph, asked).collect()}, {tuple(x) for x in joins(graph, asked).collect()}
        assert want and got == want


def test_pass_needs_no_join_of_ancestors(spark, monkeypatch):
    """Questions inside functions are answered without the joins."""
    r = random.Random(3)
    nodes, flows, asked = function(r, "f", 7, None)
    columns = [c.split()[0] for c in NODES.split(", ")]
    graph = Graph(spark, {"nodes": spark.createDataFrame([tuple(x[c] for c in columns) for x in nodes], NODES), "dfg_edges": spark.createDataFrame(flows, "file string, src long, dst long")})
    guards.excludes_zero(graph, spark.createDataFrame(asked, "file string, guard long, value long, target long, capacity long"))
    assert "ancestry" not in vars(graph) and "constants" not in vars(graph)


def test_nearest_guards_by_brute_force(spark):
    rng, rows = random.Random(7), []
    for f in ("f", "g"):
        for i in range(120):
            # functions of ten nodes whose ways up stay inside, leave them, end in a cycle or at a node without function
            up = rng.choice([None, i - i % 10, rng.randrange(i - i % 10, i + 1), rng.randrange(120), i - 1])
            kind = rng.choice(["Conditional", "Loop", "Call", "Call", "Call", "MethodDef"])
            fields = ["x", "condition"] if i % 4 == 0 else []
            rows.append((f, i, kind, None if i % 10 == 9 else i - i % 10, up, [1000 + i, 2000 + i][: i % 3], fields))
    n = spark.createDataFrame(rows, "file string, id long, kind string, function_id long, parent_id long, children array<long>, field_names array<string>")
    graph = Graph(spark, {"nodes": n})
    for kinds in (["Conditional"], ["Conditional", "Loop"]):
        at = {(r.file, r.id): r.condition for r in conditions(graph, kinds).collect()}
        parents, want = {r[:2]: r[4] for r in rows}, {}
        for f, i, *_ in rows:
            p, seen = i, set()
            while p is not None and p not in seen and (f, p) not in at:
                seen.add(p)
                p = parents.get((f, p))
            if (f, p) in at:
                want[f, i] = at[f, p]
        out = [tuple(r) for r in guarding(graph, kinds).collect()]
        assert len(out) == len(want) and {(f, d): c for f, d, c in out} == want


def test_guards_inside_functions_need_no_ancestors(spark):
    rows = [("f", 1, "MethodDef", 1, None, [2]), ("f", 2, "Loop", 1, 1, [3, 4]), ("f", 3, "Literal", 1, 2, []), ("f", 4, "Call", 1, 2, []), ("f", 5, "Call", 1, 1, [])]
    graph = Graph(spark, {"nodes": spark.createDataFrame(rows, "file string, id long, kind string, function_id long, parent_id long, children array<long>")})
    assert sorted(map(tuple, guarding(graph, ["Loop"]).collect())) == [("f", i, 3) for i in (2, 3, 4)]
    assert "ancestry" not in graph.__dict__
