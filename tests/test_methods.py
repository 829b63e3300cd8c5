"""Rule methods over the source-like view, against the registered SQL on a small scale."""

from collections import Counter

import duckdb
import pytest

from quillgraph.functions import language as L
from quillgraph.plans import catalogue
from quillgraph.plans.compiler import Compiler, negated, run_rules
from quillgraph.plans.graph import Graph

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["param_count", "eval_bool", "alloc_size", "null_source", "branch_condition", "in_dead_branch", "excludes_zero", "bounds_value", "meta_java", "name_refers_to", "dfg_neighbours", "sink_markdown"],
)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want) and want


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("f", 1, "MethodDef", "m", None, None), ("f", 2, "Block", None, 1, 1), ("f", 3, "Call", "c", 2, 1), ("f", 4, "Call", "d", 1, 1)]
    nodes = spark.createDataFrame(rows, "file string, id long, kind string, name string, parent_id long, function_id long")
    return Graph(spark, {"nodes": nodes})


def ids(graph, find, extra=""):
    found = run_rules(graph, f'{extra} rule "r" {{ severity: low {find} }}')
    return sorted(r["matched_nodes"][0] for r in found.collect())


def test_recursion_is_a_least_fixpoint(graph):
    # each call of itself twice: nothing is added, and nothing unfolds without end
    assert ids(graph, "find n: Call where p(n)", 'pred p(n: Node) = n.name() == "c" or p(n) and p(n)') == [3]
    assert ids(graph, "find n: Call where p(n)", "pred p(n: Node) = p(n)") == []
    rules = L.parse('pred p(n: Node) = p(n.parent()) and p(n.parent().parent()) rule "r" { find n: Call where p(n) }')
    with pytest.raises(L.RuleError):
        Compiler(graph, rules).find(rules.rules[0].clauses[0])


def test_predicates_anywhere_and_bare_patterns(graph):
    up = 'pred named(n: Node) = n.name() == "m"'
    assert ids(graph, "find n: Call where let q = n.parent() in named(q)", up) == [4]
    assert ids(graph, "find n: Call where forall(m: MethodDef | not named(m) or n.parent().id() == m.id())", up) == [4]
    for bad in ("find n: Call where /x/", 'find n: Call where ["x"]'):
        with pytest.raises(L.RuleError):
            ids(graph, bad)


def test_negation_moves_to_the_leaves():
    x, y = (L.Compare("==", L.Method(L.Var("a"), m, ()), L.Lit(1)) for m in ("line", "id"))
    e = L.Logic("or", (L.Logic("not", (x,)), y))
    assert negated(e) == L.Logic("and", (x, L.Compare("!=", y.left, y.right)))
    less = L.Compare("<", x.left, x.right)
    # orderings hold between integers only, so a negated one isn't the opposite one
    assert negated(less) == L.Logic("not", (less,)) and negated(negated(less)) == less
