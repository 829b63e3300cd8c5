"""Reachability and what is built on it carry no more than they need."""

import random

from quillgraph.operators import analyses, closure, guards
from quillgraph.plans import views


def test_reach_knows_the_least_node_before_each(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    want = {}
    for seed in (0, 1):
        hops, front = {seed: 0}, [seed]
        while front:
            new = sorted({b for a, b in edges if a in front and b not in hops})
            for b in new:
                want[seed, b] = (hops[front[0]] + 1, min(a for a, c in edges if c == b and a in front and a != b))
            hops |= {b: hops[front[0]] + 1 for b in new}
            front = new
    e = spark.createDataFrame([("f", *x) for x in edges], "file string, src long, dst long")
    seeds = spark.createDataFrame([("f", 0), ("f", 1)], "file string, seed long")
    out = closure.reach(spark, seeds, e, ["file"], via=True).where("hops > 0").collect()
    assert {(r.seed, r.node): (r.hops, r.src) for r in out} == want and len(out) == len(want)


def test_seeds_that_start_from_several_nodes_are_reached_once(spark):
    e = spark.createDataFrame([("f", 1, 3), ("f", 2, 3), ("f", 3, 4)], "file string, src long, dst long")
    seeds = spark.createDataFrame([("f", 9, 1), ("f", 9, 2)], "file string, seed long, node long")
    out = closure.reach(spark, seeds, e, ["file"]).select("seed", "node", "hops").collect()
    assert sorted(map(tuple, out)) == [(9, 1, 0), (9, 2, 0), (9, 3, 1), (9, 4, 2)]


def test_arguments_of_calls_alone(spark, tmp_path):
    rows = "id + 1 AS p_partkey, 'n' || (id % 7) AS p_name, 'Brand#' || (id % 3) AS p_brand, 'T' AS p_type, CAST(id % 50 AS int) + 1 AS p_size"
    spark.range(300).selectExpr(*rows.split(", ")).write.parquet(f"{tmp_path}/part.parquet")
    g = views.source(spark, str(tmp_path)).written()
    some = analyses.arguments(g, "Call").count()
    assert some == g.nodes.where("kind = 'Call'").count() < analyses.arguments(g).count()
    asked = g.nodes.where("kind = 'Conditional'").selectExpr("file", "id AS guard", "function_id + 2 AS value", "id AS target", "0L AS capacity")
    compared = guards._comparison(g, guards._occurrence(g, guards._roots(g, asked)))
    # what is found below a condition is written, not computed again by every step after it
    assert compared.count() == asked.count() and "Join" not in compared._jdf.queryExecution().optimizedPlan().toString()
