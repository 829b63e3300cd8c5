"""Control flow and data flow built from syntax trees."""

from quillgraph.operators import construct
from quillgraph.plans.graph import Graph


def plant(*spec):
    """(id, kind, {field: children} or [children], more) rows as a tree."""
    tree = {}
    for n, kind, below, *more in spec:
        pairs = [(f, c) for f, cs in below.items() for c in cs] if isinstance(below, dict) else [("", c) for c in below]
        tree[n] = {"kind": kind, "node_type": kind.lower(), "name": None, "text": None, "operator": None, "loop_kind": None}
        tree[n] |= {"children": [c for _, c in pairs], "fields": [f for f, _ in pairs]} | (more[0] if more else {})
    return tree


def flow(*spec, lang="c"):
    nodes, edges = construct.function_flow(plant(*spec), 1, lang)
    place = {n: b for b, held in enumerate(nodes) for n in held}
    return place, {(a, b, kind[0]) for a, b, _, kind in edges}, len(nodes)


def test_straight_and_empty():
    assert flow((1, "MethodDef", []))[1:] == (set(), 1) or flow((1, "MethodDef", []))[1:] == ({(0, 1, "n")}, 2)
    place, edges, n = flow((1, "MethodDef", [2, 3]), (2, "ExprStmt", [4]), (3, "Return", []), (4, "Call", []))
    assert place == {2: 0, 4: 0, 3: 0} and edges == {(0, 1, "n")} and n == 2


def test_branches_and_short_circuit():
    spec = [(1, "MethodDef", {"body": [2]}), (2, "Block", [3, 9]), (3, "Conditional", {"condition": [4], "consequence": [7], "alternative": [8]}),
            (4, "BinaryOp", [5, 6], {"operator": "&&"}), (5, "Identifier", []), (6, "Identifier", []), (7, "ExprStmt", []), (8, "ExprStmt", []), (9, "ExprStmt", [])]
    place, edges, n = flow(*spec)
    assert n == 6 and place[3] == place[5] == 0 and place[6] != 0
    # the first operand being false leads to the alternative at once
    assert edges == {(0, place[6], "n"), (0, place[8], "n"), (place[6], place[7], "n"), (place[6], place[8], "n"), (place[7], place[9], "n"), (place[8], place[9], "n"), (place[9], n - 1, "n")}


def test_loop_break_continue():
    spec = [(1, "MethodDef", [2, 10]), (2, "Loop", {"condition": [3], "body": [4]}), (3, "Identifier", []), (4, "Block", [5, 7, 8]), (5, "Conditional", {"condition": [6], "consequence": [9]}),
            (6, "Identifier", []), (9, "Break", []), (7, "Continue", []), (8, "ExprStmt", []), (10, "Return", [])]
    place, edges, n = flow(*spec)
    assert (place[9], place[10], "n") in edges and (place[7], place[3], "n") in edges and (place[3], place[10], "n") in edges
    # what stands behind continue is never reached, and goes on to the loop's head
    assert not any(b == place[8] for _, b, _ in edges) and (place[8], place[3], "n") in edges


def test_for_do_and_endless():
    spec = [(1, "MethodDef", [2]), (2, "Loop", {"initializer": [3], "condition": [4], "update": [5], "body": [6]}), *[(i, "Identifier", []) for i in (3, 4, 5)], (6, "Continue", [])]
    place, edges, _ = flow(*spec)
    # the update has one way to it, so it ends the body's block
    assert place[3] == place[2] and place[6] == place[5] and (place[5], place[4], "n") in edges and (place[4], place[6], "n") in edges
    do = [(1, "MethodDef", [2]), (2, "Loop", {"body": [3], "condition": [4]}, {"loop_kind": "do"}), (3, "ExprStmt", []), (4, "Identifier", [])]
    place, edges, n = flow(*do)
    # the body comes first, and the test is at its end
    assert place[3] == place[4] and (place[4], place[3], "n") in edges and (place[4], n - 1, "n") in edges
    endless = [(1, "MethodDef", [2]), (2, "Loop", {"body": [3]}, {"loop_kind": "loop"}), (3, "ExprStmt", [])]
    place, edges, n = flow(*endless, lang="rust")
    assert not any(b == n - 1 for _, b, _ in edges)


def test_switch_goto_try():
    switch = [(1, "MethodDef", [2, 20]), (2, "Switch", {"condition": [3], "body": [4]}), (3, "Identifier", []), (4, "Block", [5, 6]), (5, "Case", {"value": [7], "": [8]}), (6, "SwitchDefault", [9, 10]),
              (7, "Literal", []), (8, "ExprStmt", []), (9, "ExprStmt", []), (10, "Break", []), (20, "ExprStmt", [])]
    place, edges, _ = flow(*switch)
    assert {(place[3], place[5], "n"), (place[3], place[6], "n"), (place[3], place[20], "n"), (place[8], place[6], "n"), (place[10], place[20], "n")} <= edges
    place, edges, _ = flow(*switch, lang="go")
    assert (place[8], place[6], "n") not in edges and (place[8], place[20], "n") in edges
    goto = [(1, "MethodDef", [2, 3, 4]), (2, "Goto", [5]), (5, "Identifier", [], {"text": "out"}), (3, "ExprStmt", []), (4, "Label", [6, 7]), (6, "Identifier", [], {"text": "out"}), (7, "Return", [])]
    place, edges, _ = flow(*goto)
    assert (place[2], place[4], "n") in edges and place[4] == place[7] and not any(b == place[3] for _, b, _ in edges)
    tried = [(1, "MethodDef", [2, 9]), (2, "Try", [3, 4]), (3, "Block", [5, 6]), (4, "Catch", {"body": [7]}), (5, "Call", []), (6, "Throw", []), (7, "Block", [8]), (8, "ExprStmt", []), (9, "Return", [])]
    place, edges, _ = flow(*tried)
    assert (place[5], place[4], "e") in edges and (place[6], place[4], "e") in edges and place[8] == place[4]
    # the body always throws, so only the clause goes on to what follows
    assert place[9] == place[8] and (place[2], place[5], "n") in edges and (place[2], place[4], "e") in edges


def test_noreturn_and_depth():
    place, edges, n = flow((1, "MethodDef", [2, 3]), (2, "Call", [], {"name": "abort"}), (3, "ExprStmt", []))
    assert place[2] != place[3] and not any(a == place[2] for a, _, _ in edges)
    # nested deeper than a call stack
    deep = [(1, "MethodDef", [2])] + [(i, "Conditional", {"consequence": [i + 1]}) for i in range(2, 6000)] + [(6000, "ExprStmt", [])]
    assert flow(*deep)[2] > 5000


def test_built_tables(spark):
    # int f(x) { y = 1; while (x) { use(y); y = x; } gone(); } with gone marked in its file
    n = [(1, "MethodDef", None, [2, 3, 4, 12], ["", "", "", ""], "f", None), (2, "ParamDef", 1, [], [], "x", None), (3, "Assign", 1, [13, 14], ["left", "right"], None, None),
         (13, "Identifier", 3, [], [], None, "y"), (14, "Literal", 3, [], [], None, "1"), (4, "Loop", 1, [5, 6], ["condition", "body"], None, None), (5, "Identifier", 4, [], [], None, "x"), (6, "Block", 4, [7, 9], ["", ""], None, None),
         (7, "Call", 6, [8], [""], "use", None), (8, "Identifier", 7, [], [], None, "y"), (9, "Assign", 6, [10, 11], ["left", "right"], None, None), (10, "Identifier", 9, [], [], None, "y"), (11, "Identifier", 9, [], [], None, "x"),
         (12, "Call", 1, [], [], "gone", None)]
    rows = [("a", "c", i, k, k.lower(), p, 1, c, f, name, text, i, 0) for i, k, p, c, f, name, text in n]
    rows.append(("a", "c", 50, "Node", "declaration", None, None, [], [], "gone", "_Noreturn void gone(void);", 50, 0))
    nodes = spark.createDataFrame(rows, "file string, lang string, id long, kind string, node_type string, parent_id long, function_id long, children array<long>, field_names array<string>, name string, text string, line long, column long")
    graph = construct.with_flows(Graph(spark, {"nodes": nodes}))
    place = {r["node_id"]: r["block_ord"] for r in graph.table("block_nodes").collect()}
    edges = {(r["src"], r["dst"]) for r in graph.table("cfg_edges").collect()}
    assert (place[9], place[5]) in edges and (place[5], place[12]) in edges and not any(a == place[12] for a, _ in edges)
    flows = {(r["src"], r["dst"], r["variable"], r["edge_type"]) for r in graph.table("dfg_edges").collect()}
    assert flows == {(2, 5, "x", "REACHING_DEF"), (2, 11, "x", "REACHING_DEF"), (3, 8, "y", "REACHING_DEF"), (9, 8, "y", "LOOP_CARRY")}
    assert construct.control_flow(Graph(spark, {"nodes": nodes.limit(0)})).count() == 0
