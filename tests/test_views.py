"""Views take every row of their tables; queries over them against brute force."""

import datetime

import pytest

from quillgraph.operators.cfg import function_facts
from quillgraph.plans import catalogue, views

#: After the eighth event come a type that was not seen before, and edges.
HISTORIES = {
    1: "view click view click view click view click purchase view error signup click".split(),
    2: "click view".split(),
    3: "signup view purchase signup view purchase signup view purchase error click click".split(),
}


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 100 + i, start + datetime.timedelta(hours=i), u, t, 1.0, None) for u, ts in HISTORIES.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return str(at)


def flow_graph(history):
    order = list(dict.fromkeys(history))
    pairs = {(order.index(a), order.index(b), "exception" if b == "error" else "normal") for a, b in zip(history, history[1:], strict=False)}
    return order, pairs


def test_flow_takes_whole_histories(spark, events_dir):
    g = views.flow(spark, events_dir)
    assert g.nodes.count() == sum(map(len, HISTORIES.values()))
    edges = {(r["function"], r["src"], r["dst"], r["kind"]) for r in g.table("cfg_edges").collect()}
    assert edges == {(u, *e) for u, h in HISTORIES.items() for e in flow_graph(h)[1]}


def test_flow_queries(spark, events_dir):
    facts = {u: set(function_facts(list(range(len(flow_graph(h)[0]))), sorted(flow_graph(h)[1]))) for u, h in HISTORIES.items()}
    run = lambda name: sorted(tuple(r) for r in catalogue.queries()[name](spark, events_dir).collect())
    for name, fact in (("cfg_post_dominates", "postdom"), ("cfg_frontier", "frontier"), ("cfg_scc", "scc"), ("cfg_loop_no_exit", "noexit"), ("cfg_in_loop", "loop")):
        assert run(name) == sorted((u, a, b) for u, own in facts.items() for f, a, b in own if f == fact), name
    at = {(u, i): flow_graph(h)[0].index(t) for u, h in HISTORIES.items() for i, t in enumerate(h)}
    for name, holds in (
        ("cfg_dominates", lambda u, a, b: ("dom", a, b) in facts[u]),
        ("cfg_reaches", lambda u, a, b: ("reach", a, b) in facts[u]),
        ("cfg_same_block", lambda u, a, b: a == b),
    ):
        want = [(u * 100 + i, u * 100 + j) for u, h in HISTORIES.items() for i, t in enumerate(h) if t == "click" for j in range(i + 1, len(h)) if holds(u, at[u, i], at[u, j])]
        assert [r[3:] for r in run(name)] == sorted(want), name
    exc = [u * 100 + i for (u, i), b in at.items() if ("exc", b, b) in facts[u]]
    assert [r[3] for r in run("cfg_exception_path")] == sorted(exc)


# (order, part, supplier, quantity, flag)
LINES = [(1, 1, 1, 3.0, "A"), (1, 2, 1, 50.0, "N"), (2, 2, 2, 7.0, "R"), (2, 1, 2, 1.0, "R"), (3, 3, 1, 48.0, "R"), (4, 2, 3, 10.0, "N"), (4, 3, 3, 49.0, "A")]
ORDERS = {1: 1, 2: 1, 3: 2, 4: 3}


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("lines")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    put("lineitem", LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string")
    put("orders", [(o, c, "O", "1-URGENT") for o, c in ORDERS.items()], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    put("supplier", [(s, f"s{s}", -1.0 if s < 3 else 1.0) for s in (1, 2, 3)], "s_suppkey long, s_name string, s_acctbal double")
    put("part", [(p, "b", "t", 10 * p) for p in (1, 2, 3)], "p_partkey long, p_brand string, p_type string, p_size int")
    put("customer", [(c, f"c{c}", "BUILDING") for c in (1, 2, 3)], "c_custkey long, c_name string, c_mktsegment string")
    return str(at)


def test_data_flow_queries(spark, lines_dir):
    edges = set()
    for o, p, s, _, v in LINES:
        edges |= {(s * 8 + 5, p * 8 + 6, v), (p * 8 + 6, o * 8 + 3, v), (o * 8 + 3, ORDERS[o] * 8 + 2, v)}

    def closed(start, arcs):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            more = {b for a, b, _ in arcs if a == x} - seen
            seen |= more
            todo += more
        return seen

    assert {tuple(r) for r in views.data(spark, lines_dir).table("dfg_edges").select("src", "dst", "variable").collect()} == edges
    debt, wall = (13, 21), {30}
    kept = {e for e in edges if e[1] not in wall}
    target = {c * 8 + 2 for c in ORDERS.values()}
    points = {(a, b) for a, b, v in edges if v == "R"}
    run = lambda name: {tuple(r) for r in catalogue.queries()[name](spark, lines_dir).collect()}
    assert run("dfg_flows_to") == {(a, b) for a, b, v in edges if v == "A"}
    assert run("dfg_reaches") == {(s, x) for s in debt for x in closed(s, edges)}
    assert run("dfg_barrier") == {(s, x) for s in debt for x in closed(s, kept)}
    assert run("dfg_def_use") == {(a,) for a, _, v in edges if v == "R" and a in {b for _, b, w in edges if w == "N"}}
    for name, arcs in (("taint_basic", edges), ("taint_sanitized", kept)):
        assert {r[3:] for r in run(name)} == {(s, x) for s in debt for x in closed(s, arcs) & target}
    assert {r[:3] for r in run("taint_path")} == {(s, x, 4) for s in debt for x in closed(s, edges) & target}
    assert run("ana_alias") == {(x, y) for x, t in points for y, u in points if t == u and x < y}
    null = {e for e in edges if e[2] != "R"}
    assert run("ana_nullability") == {(x, 13) for x in closed(13, null)}


def test_changes_of_all_events(spark, tmp_path):
    # (event, user, day): users 7 and 104 are equal modulo 97; events of multiples of 5 and user 7 count too
    rows = [(5, 7, 3), (10, 7, 20), (11, 104, 2), (12, 1, 18), (13, 2, 4), (14, 2, 29), (14, 3, 1), (14, 3, 16)]
    rows = [(i, datetime.datetime(2024, 1, d), u, "view", 1.0, None) for i, u, d in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["set_changes"](spark, str(tmp_path)).collect())
    assert got == [("view1", "added"), ("view104", "removed"), ("view2", "changed"), ("view7", "changed")]


def test_dirty_callers_of_all_orders(spark, tmp_path):
    orders = {1: 7, 2: 1, 3: 2, 2018: 3, 5000: 2018, 6: 9, 12: 6, 1016: 8}
    spark.createDataFrame(list(orders.items()), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(r["fn"] for r in catalogue.queries()["incr_dirty_callers"](spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 7, 2018, 5000]
