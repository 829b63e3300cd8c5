"""Plans that must not grow faster than their tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analyses, calls
from quillgraph.plans import catalogue, views
from quillgraph.plans.compiler import Compiler, run_rules
from quillgraph.plans.graph import Graph


@pytest.fixture(scope="module")
def parts_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("parts")
    rows = "id + 1 AS p_partkey, 'n' || (id % 7) AS p_name, 'Brand#' || (id % 3) AS p_brand, 'T' AS p_type, CAST(id % 50 AS int) + 1 AS p_size"
    spark.range(12_000).selectExpr(*rows.split(", ")).coalesce(1).write.parquet(f"{at}/part.parquet")
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BY_MERGES = ["call_constructors", "call_fields", "call_arrays"]


@pytest.mark.parametrize("name", BY_MERGES)
def test_no_broadcast_by_guessed_size(spark, parts_dir, name):
    assert "Broadcast" not in plan(catalogue.queries()[name](spark, parts_dir))


@pytest.mark.parametrize("view", [views.source, views.program])
def test_views_are_dealt_out(spark, parts_dir, view):
    assert view(spark, parts_dir).nodes.rdd.getNumPartitions() == 3


def test_callees_by_brute_force(spark):
    files, names = ("f", "g", "h"), ("a", "b", None)
    defs = [(f, i * 10 + k, n, q) for k, f in enumerate(files) for i, (n, q) in enumerate(itertools.product(names, ("x.a", "a", None))) if (i + k) % 3]
    calls = [(f, i, n, q) for f in (*files, "z") for i, (n, q) in enumerate(itertools.product(names, ("x.a", "b", None)))]
    want = {}
    for f, c, n, q in calls:
        for ask, key in enumerate((q, n)):
            for df, i, dn, dq in defs:
                for rank, own in enumerate((dq, dn)):
                    if key is not None and key == own:
                        want[f, c] = min(want.get((f, c), (9,)), (ask, rank, df != f, df, i))
    c = spark.createDataFrame(calls, "file string, call_node long, callee_name string, qualified_callee string")
    d = spark.createDataFrame(defs, "file string, id long, name string, qualified_name string")
    out = analyses.resolve_callees(c, d)
    assert {(r.file, r.call_node): (r.target_file, r.target) for r in out.collect()} == {k: v[3:] for k, v in want.items()}
    # definitions are reduced to one row a key before calls meet them
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [key") >= 2


def test_code_writes_parts_not_nodes(spark, parts_dir):
    graph = views.code(spark, parts_dir)
    for name in ("nodes", "dfg_edges", "cfg_edges", "meta_cpp"):
        assert all("quillgraph-parts" in f for f in graph.table(name).inputFiles())
    assert views.code(spark, parts_dir) is graph
    rows = graph.nodes.where("id = 64 * 30 + 8")
    assert rows.exceptAll(views.source(spark, parts_dir).nodes.where("id = 64 * 30 + 8")).isEmpty() and rows.count() == 1


def test_ancestry_is_joined_once_and_not_by_function(spark, parts_dir, monkeypatch):
    marks, mark = [], Compiler.mark
    monkeypatch.setattr(Compiler, "mark", lambda self, *a: marks.append(a) or mark(self, *a))
    graph = views.code(spark, parts_dir)
    rule = 'find g: Conditional, t: Call where g.same_function(t) and t.has_ancestor(g.id()) and t.name() == "use"'
    out = run_rules(graph, f'rule "r" {{ severity: low {rule} }}')
    assert not marks and out.count() == 2 * 12_000


def test_repeated_navigation_is_joined_once(spark, parts_dir, monkeypatch):
    steps, step = [], Compiler.step
    monkeypatch.setattr(Compiler, "step", lambda self, *a: steps.append(a) or step(self, *a))
    out = catalogue.queries()["name_refers_to"](spark, parts_dir)
    # the declaration and the parent
    assert len(steps) == 2
    # words that their function declares are not sent to the one task of the word
    assert "spread" in out._jdf.queryExecution().analyzed().toString()


def ends_of(spark, rows):
    """A graph of (file, id, kind, channel) ends, each with an identifier below it."""
    nodes = [(f, i, k, None, None) for f, i, k, _ in rows] + [(f, -i, "Identifier", c, i) for f, i, _, c in rows]
    return Graph(spark, {"nodes": spark.createDataFrame(nodes, "file string, id long, kind string, text string, parent_id long")})


def test_channels_by_brute_force(spark, monkeypatch):
    for name, size in (("TILE", 4), ("RUN", 3), ("PAIRS", 20), ("ENDS", 7)):
        monkeypatch.setattr(calls, name, size)
    kinds = ("SendStmt", "ReceiveExpr", "ReceiveExpr")
    rows = [(f"f{i % 2}", i, kinds[i % 3], (None, "a", "a", "a", "b", "c")[i * i % 11 % 6]) for i in range(1, 90)]
    rows += [("g", 100 + i, "SendStmt", "a") for i in range(5)] + [("h", 110 + i, "ReceiveExpr", "a") for i in range(5)]
    want = sorted((f, a, b, c) for f, a, k, c in rows for g, b, m, d in rows if (k, m) == kinds[:2] and f == g and c == d is not None)
    assert len(want) > 100 and sorted(map(tuple, calls.channels(ends_of(spark, rows)).collect())) == want
    # one that sends and receives is paired with itself; without ends of a side there is nothing
    some = ends_of(spark, [("f", 1, "Both", "a"), ("f", 2, "ReceiveExpr", "a")])
    both = calls.channels(some, send=F.col("kind") == "Both", receive=F.col("kind").isin("Both", "ReceiveExpr"))
    assert sorted((r.src, r.dst) for r in both.collect()) == [(1, 1), (1, 2)]
    assert calls.channels(ends_of(spark, [("f", 1, "SendStmt", "a")])).isEmpty()


def test_a_large_channel_is_dealt_out_and_written_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(calls, "TILE", 500)
    monkeypatch.setattr(calls, "PAIRS", 500_000)
    n = spark.range(4000).selectExpr("'f' AS file", "id * 2 + 1 AS id", "IF(id % 2 = 0, 'SendStmt', 'ReceiveExpr') AS kind", "NULL AS text", "NULL AS parent_id")
    n = n.unionByName(n.selectExpr("file", "id + 1 AS id", "'Identifier' AS kind", "'a' AS text", "id AS parent_id"))
    calls.channels(Graph(spark, {"nodes": n})).select("file", "src", "dst").write.parquet(f"{tmp_path}/out")
    files = list((tmp_path / "out").glob("part-*.parquet"))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.distinct().count() == out.count() == 2000 * 2000
    # a plain join's pairs took 3.1 bytes each on 60 copies of part
    assert sum(f.stat().st_size for f in files) < 2000 * 2000 and len(files) > 1
