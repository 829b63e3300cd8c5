"""Scans of sources, measures of runs and ways to call a function: what the registered queries do not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import calls, profile
from quillgraph.plans.graph import Graph
from quillgraph.sources import scans

NODES = "file string, id long, kind string, node_type string, parent_id long, function_id long, name string, text string, line long, children array<long>"


def graph(spark, *rows):
    return Graph(spark, {"nodes": spark.createDataFrame(list(rows), NODES)})


def test_comments_allocators_and_global_changes(spark):
    g = graph(
        spark,
        ("a", 1, "Node", "comment", None, None, None, "// hi", 3, []), ("a", 2, "Node", "block_comment", None, None, None, None, 4, []),
        ("a", 3, "MethodDef", "function_definition", None, 3, "mine", None, 5, [4]), ("a", 4, "Node", "attribute_specifier", 3, 3, None, "__attribute__((ALLOC_SIZE( 2 )))", 5, []),
        ("a", 5, "Node", "declaration", None, None, "pool", None, 6, [6]), ("a", 6, "Node", "attribute", 5, None, None, "malloc", 6, []),
        ("a", 7, "Node", "declaration", None, None, "two", None, 7, [8]), ("a", 8, "Node", "attribute", 7, None, None, "alloc_size(1, 2)", 7, []),
        ("a", 9, "Node", "declaration", None, None, "none", None, 8, [10]), ("a", 10, "Node", "attribute", 9, None, None, "unused", 8, []),
        ("a", 11, "Node", "declaration", 3, 3, None, None, 9, []),
    )
    assert sorted(map(tuple, scans.comments(g).collect())) == [("a", 3, "// hi"), ("a", 4, None)]
    assert sorted(map(tuple, scans.allocators(g).collect())) == [("a", "mine", 1), ("a", "pool", -1), ("a", "two", -1)]
    assert sorted(r["id"] for r in scans.affects_all(g).collect()) == [5, 7, 9]
    assert {k: v.count() for k, v in scans.light_index(g).items()} == {"functions": 1, "calls": 0, "constants": 0}
    assert scans.allocators(g.only(nodes=g.nodes.limit(0))).count() == 0


def test_macros_and_aliases(spark):
    lines = ["#define MALLOC malloc", "#define OLD MALLOC", "# define P(a,b) (xalloc(a))", "#define N 3", "#define __X y", "#define LOOP loop", "#define loop LOOP", "#undef Q", None, "#define EMPTY"]
    m = scans.macros(spark.createDataFrame([("a", t) for t in lines], "file string, text string"))
    got = {r["name"]: (r["params"], r["body"], r["alias"]) for r in m.collect()}
    assert got["MALLOC"] == ([], "malloc", "malloc") and got["P"] == (["a", "b"], "(xalloc(a))", "xalloc") and got["N"][2] is None and got["__X"][2] is None and got["EMPTY"][1:] == ("", None) and len(got) == 8
    names = spark.createDataFrame([("a", "old"), ("a", "free"), ("b", "old"), ("a", "loop")], "file string, name string")
    resolved = {(r["file"], r["name"]): r["resolved"] for r in scans.resolve_aliases(names, m).collect()}
    assert resolved[("a", "old")] == "malloc" and resolved[("a", "free")] == "free" and resolved[("b", "old")] == "old" and resolved[("a", "loop")] in ("loop", "LOOP")


def test_string_literals(spark):
    cases = {'"a\\tb"': "a\tb", 'r#"x"#': "x", '"\\\\n"': "\\n", '"\\q"': "q", '"': '"', '""': "", "abc": "", '"end\\': '"end\\', '"\\0é\\""': '\0é"', '"line\nbreak"': "line\nbreak"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    got = {r["raw"]: r["v"] for r in df.select("raw", scans.decode_string(F.col("raw")).alias("v")).collect()}
    assert got == cases | {None: None}


def test_edits_apply(spark):
    rng = random.Random(3)
    text = lambda: bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(12)))
    pairs = [(i, text(), text()) for i in range(300)] + [(300, None, b"x"), (301, b"x" * 100_000, b"x" * 100_001), (302, None, None)]
    df = spark.createDataFrame(pairs, "i long, a binary, b binary")
    for r, (_, a, b) in zip(df.select("i", scans.compute_edit("a", "b").alias("e")).orderBy("i").collect(), pairs, strict=True):
        a, b, e = a or b"", b or b"", r["e"]
        if a == b:
            assert e["change"] is None
            continue
        s, x, y = e["start_byte"], e["old_end_byte"], e["new_end_byte"]
        assert a[:s] + b[s:y] + a[x:] == b and (s == min(x, y) or a[x - 1] != b[y - 1]) and (s == min(len(a), len(b)) or a[s] != b[s] or x == s or y == s)
        assert e["change"] == ("insert" if s == x else "delete" if s == y else "replace")
        assert (e["old_end_row"], e["old_end_column"]) == (a[:x].count(b"\n"), len(a[:x].split(b"\n")[-1]))


def test_reports(spark):
    times = profile.Stages(spark)
    for name in ("rule.<x>", "load", "load"):
        with times.stage(name):
            pass
    with pytest.raises(ZeroDivisionError), times.stage("load"):
        1 / 0
    stages = profile.stages(times.rows())
    assert {r["name"]: (r["count"], r["stddev"] >= 0) for r in stages.collect()} == {"rule.<x>": (1, True), "load": (3, True)}
    cache = spark.createDataFrame([("c", 3, 1, 1, 0, 10), ("c", 0, 0, 0, 0, 4), ("idle", 0, 0, 0, 0, 0)], "name string, hits long, misses long, inserts long, evictions long, bytes long")
    count = profile.counters(spark.createDataFrame([("n", 2), ("n", 3)], "name string, value long"))
    shot = profile.snapshot(2.0, stages=stages, caches=profile.caches(cache), counters=count)
    assert [c["hit_rate"] for c in shot["caches"]] == [75.0, 0.0] and shot["caches"][0]["bytes"] == 10
    assert json.loads(profile.json_report(shot)) == json.loads(profile.json_report(shot, pretty=True)) == shot
    assert "75.0%" in profile.text_report(shot) and "2.5" in profile.text_report(shot) and "rule.&lt;x&gt;" in profile.html_report(shot)
    assert profile.text_report({"elapsed": 0.0, "counters": []}) == "elapsed 0.000s\n"


def test_threads(spark):
    rng = random.Random(5)
    tasks = [(rng.randrange(4), b, b + rng.randrange(1, 50)) for b in (rng.randrange(10**6) // 1000 * 10 for _ in range(400))]
    got = profile.threads(spark.createDataFrame(tasks + [(9, 77, None)], "worker long, begin long, end long"), 4).first()
    peak = max(sum(b <= t < e for _, b, e in tasks) + (77 <= t) for _, t, _ in tasks)
    assert (got["started"], got["submitted"], got["completed"], got["peak"]) == (5, 401, 400, peak)
    none = profile.threads(spark.createDataFrame([], "worker long, begin long, end long"), 4).first()
    assert (none["submitted"], none["peak"], none["utilisation"]) == (0, 0, 0.0)


def test_summaries_of_returned_expressions(spark):
    g = graph(
        spark,
        ("a", 1, "MethodDef", "f", None, 1, "pick", None, 1, [2, 3, 4]), ("a", 2, "ParamDef", "p", 1, 1, "x", None, 1, []), ("a", 3, "ParamDef", "p", 1, 1, "y", None, 2, []),
        ("a", 4, "Return", "r", 1, 1, None, None, 3, [5]), ("a", 5, "BinaryOp", "b", 4, 1, None, None, 3, [6]), ("a", 6, "Identifier", "i", 5, 1, None, "y", 3, []),
    )
    edges = spark.createDataFrame([("a", 3, 6)], "file string, src long, dst long")
    assert list(map(tuple, calls.summaries(g.only(dfg_edges=edges)).collect())) == [("a", "pick", "TaintReturn", 1)]
    assert calls.summaries(g).count() == 0
