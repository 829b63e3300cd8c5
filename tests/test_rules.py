import pytest

from quillgraph.functions import language as L
from quillgraph.operators.analyses import fold
from quillgraph.operators.cfg import function_facts
from quillgraph.operators.taint import registry
from quillgraph.plans.compiler import run_rules
from quillgraph.plans.graph import Graph

NODES = "file string, id long, kind string, node_type string, name string, text string, parent_id long, function_id long, line long, argument_count long, lang string, children array<long>"


def graph(spark, rows, **tables):
    rows = [(f, i, k, k.lower(), n, n, p, fn, line, a, "c", c) for f, i, k, n, p, fn, line, a, c in rows]
    return Graph(spark, {"nodes": spark.createDataFrame(rows, NODES)} | tables)


@pytest.fixture(scope="module")
def simple(spark):
    return graph(
        spark,
        [
            ("f", 1, "MethodDef", "outer", None, 1, 1, None, [2, 3]),
            ("f", 2, "Call", "func", 1, 1, 2, 0, []),
            ("f", 3, "Conditional", None, 1, 1, 3, None, [4]),
            ("f", 4, "Call", "other", 3, 1, 4, 2, []),
            ("g", 2, "Call", "func", None, None, 9, 1, []),
        ],
    )


def found(g, body, extra=""):
    rows = run_rules(g, f'{extra} rule "r" {{ {body} }}').collect()
    return sorted((r["file"], *r["matched_nodes"]) for r in rows)


def test_scan_and_values(simple):
    assert found(simple, "find n: Call") == [("f", 2), ("f", 4), ("g", 2)]
    assert found(simple, 'find n: Node where n.name() != "x" and n.kind() == "Conditional"') == [("f", 3)]
    assert found(simple, 'find n: Call where n.name() < "zzz"') == []
    assert found(simple, "find n: Call where n.name() == 1") == []
    assert found(simple, "find n: Node where n.name() == null") == [("f", 3)]
    assert found(simple, "find n: Call where not (n.arg_count() < 1)") == [("f", 4), ("g", 2)]
    assert found(simple, "find n: Call where n.name() in /^FU/i") == [("f", 2), ("g", 2)]
    assert found(simple, "find n: Call where n.name() in /(/") == []


def test_navigation_and_quantifiers(simple):
    assert found(simple, 'find n: Call where n.parent().kind() == "Conditional"') == [("f", 4)]
    assert found(simple, "find n: Call where n.parent() == null") == [("g", 2)]
    assert found(simple, 'find n: Call where n.ancestor("methoddef").name() == "outer"') == [("f", 2), ("f", 4)]
    assert found(simple, "find a: Conditional, b: Call where b.has_ancestor(a.id())") == [("f", 3, 4)]
    assert found(simple, "find n: Call where exists(c: Conditional | n.has_ancestor(c.id()))") == [("f", 4)]
    assert found(simple, "find n: Call where forall(c: Conditional | n.has_ancestor(c.id()))") == [("f", 4), ("g", 2)]
    assert found(simple, "find n: Call where let p = n.parent() in p.line() == 1") == [("f", 2)]
    assert found(simple, "find n: Call where small(n)", "pred small(x: Call) = x.arg_count() < 1") == [("f", 2)]
    assert found(simple, "find n: Call where loop(n)", "pred loop(x: Call) = loop(x)") == []


def test_empty_graph(spark):
    g = Graph(spark)
    assert found(g, "find n: Call") == []
    assert found(g, "find n: Call, m: Call where n.same_function(m) and exists(c: Loop | c.line() == 1)") == []


@pytest.mark.parametrize(
    "text", ["rule x {}", 'rule "x" { find n Call }', 'rule "x" { find source: Call }', 'rule "x" { find n: Call where }', 'rule "x" { severity: bad }', "@"]
)
def test_bad_texts(text):
    with pytest.raises(L.RuleError):
        L.parse(text)


def test_precedence():
    e = L.parse('rule "x" { find n: Call where a(n) or not b(n) and c(n) }').rules[0].clauses[0].where
    assert e.op == "or" and e.parts[1].op == "and" and e.parts[1].parts[0].op == "not"


def facts(blocks, edges, kind):
    return sorted((a, b) for f, a, b in function_facts(blocks, [(x, y, "normal") for x, y in edges]) if f == kind)


def test_diamond():
    edges = [(0, 1), (0, 2), (1, 3), (2, 3)]
    assert [b for a, b in facts(range(4), edges, "dom") if a == 0] == [0, 1, 2, 3]
    assert (1, 3) not in facts(range(4), edges, "dom")
    assert facts(range(4), edges, "frontier") == [(1, 3), (2, 3)]
    assert (3, 1) in facts(range(4), edges, "postdom")


def test_loops():
    assert [a for a, _ in facts(range(4), [(0, 1), (1, 2), (1, 3), (2, 1)], "loop")] == [1, 2]
    assert facts(range(4), [(0, 1), (1, 2), (1, 3), (2, 1)], "noexit") == []
    assert [a for a, _ in facts(range(3), [(0, 1), (1, 2), (2, 1)], "noexit")] == [1, 2]
    assert facts([0, 1], [], "dom") == [(0, 0), (1, 1)]


def test_taint_path(spark):
    g = graph(
        spark,
        [("f", 10, "Call", "user_input", None, 1, 1, 0, []), ("f", 11, "Assign", "x", None, 1, 2, None, []), ("f", 12, "Call", "execute_sql", None, 1, 3, 1, [])],
        dfg_edges=spark.createDataFrame([("f", 10, 11, "u"), ("f", 11, 12, "u")], "file string, src long, dst long, variable string"),
    )
    text = """source s = find n: Call where n.name() == "user_input"
    sink k = {{ kind: Call, name: "execute_sql" }}
    sanitizer z = find n: Assign
    rule "t" {{ taint {{ sources: [s] sinks: [k] sanitizers: [{}] }} }}"""
    assert [r["matched_nodes"] for r in run_rules(g, text.format("")).collect()] == [[10, 11, 12]]
    assert run_rules(g, text.format("z")).collect() == []


def cross_file(spark, used, chained=False):
    rows = [
        ("callee.py", 100, "MethodDef", "helper", None, 100, 1, None, []), ("callee.py", 101, "ParamDef", "x", 100, 100, 1, None, []),
        ("callee.py", 102, "Return", None, 100, 100, 2, None, []),
        ("caller.py", 1, "Call", "get_input", None, 1, 1, 0, []), ("caller.py", 2, "Call", "helper", None, 1, 2, 1, [1]),
        ("caller.py", 3, "Call", "execute_sql", None, 1, 3, 1, [2]),
    ]
    edges, calls = [("caller.py", 2, 3)], [("caller.py", 2, "helper")]
    if chained:  # helper hands its parameter to a function of a third file
        rows += [("callee.py", 103, "Call", "deep", 100, 100, 2, 1, [101]), ("third.py", 7, "MethodDef", "deep", None, 7, 1, None, [])]
        rows += [("third.py", 8, "ParamDef", "y", 7, 7, 1, None, []), ("third.py", 9, "Return", None, 7, 7, 2, None, [])]
        edges += [("callee.py", 103, 102), ("third.py", 8, 9)]
        calls += [("callee.py", 103, "deep")]
    elif used:
        edges += [("callee.py", 101, 102)]
    return graph(
        spark, rows, dfg_edges=spark.createDataFrame(edges, "file string, src long, dst long"),
        xcalls=spark.createDataFrame(calls, "file string, call_node long, callee_name string"),
    )


def test_cross_file_taint(spark):
    text = """source s = find n: Call where n.name() == "get_input"
    sink k = find n: Call where n.name() == "execute_sql"
    rule "t" { taint { sources: [s] sinks: [k] } }"""
    paths = lambda g: [(r["file"], r["matched_nodes"]) for r in run_rules(g, text).collect()]
    assert paths(cross_file(spark, True)) == [("caller.py", [1, 2, 3])]
    assert paths(cross_file(spark, False)) == []
    assert paths(cross_file(spark, False, chained=True)) == [("caller.py", [1, 2, 3])]


def test_registry(spark):
    sets = registry([("in", "get_input", []), ("out", "execute_sql", [0, 4])])
    g = cross_file(spark, True)
    assert [tuple(r) for r in sets["in"](g).collect()] == [("caller.py", 1)]
    assert [tuple(r) for r in sets["out"](g).collect()] == [("caller.py", 2)]


def test_fold():
    assert fold("+", [2**63 - 1, 1]) == -(2**63)
    assert fold("/", [-7, 2]) == -3 and fold("%", [-7, 2]) == -1 and fold("/", [1, 0]) is None
    assert fold("<<", [1, 64]) is None and fold("!", [0]) == 1
