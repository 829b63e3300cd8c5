"""The registered queries of the rule engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import analyses, calls, construct, dfg, profile, taint
from quillgraph.plans import views
from quillgraph.plans.compiler import run_rules
from quillgraph.sources import scans, sinks
from quillgraph.streaming import incremental

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

FLAGSHIP = """
rule "big-open" {
  severity: high
  message: "a call with arguments under an open condition"
  find o: Conditional, c: Call where c.has_ancestor(o.id()) and c.same_function(o) and c.arg_count() >= 1
}
"""


def _flat(findings: DataFrame) -> DataFrame:
    m = lambda i: F.get("matched_nodes", F.lit(i))
    return findings.select("rule_id", "severity", "file", m(0).alias("a"), m(1).alias("b"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(run_rules(views.tree(spark, sf_dir, written=True), FLAGSHIP))


def _add(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _rule(name: str, find: str, where_sql: str, extra: str = "", view=views.tree, prefix: str = views.TREE_SQL, a: str = "n.id", b: str = "NULL::BIGINT", table: str = "nodes n", **options):
    """A query that runs one rule, and its SQL over the same view."""
    text = f'{extra} rule "{name}" {{ severity: low {find} }}'
    sql = f"WITH{'' if prefix is views.TREE_SQL else ' RECURSIVE'} {prefix} SELECT '{name}' AS rule_id, 'low' AS severity, n.file AS file, {a} AS a, {b} AS b FROM {table} WHERE {where_sql}"
    _add(name, sql)(lambda spark, sf_dir: _flat(run_rules(view(spark, sf_dir, **options), text)))


# scans, comparisons, membership, patterns, predicates
_rule("scan_kind", "find n: Loop", "kind = 'Loop'")
_rule("scan_superset", "find n: Stmt where n.kind() != \"Block\"", "kind IN ('Loop', 'Conditional')")
_rule("scan_raw_type", 'find n: NodeType("Conditional")', "kind = 'Conditional'")
_rule("pred_compare", "find n: Call where n.arg_count() >= 4 and n.line() < 3", "kind = 'Call' AND argument_count >= 4 AND line < 3")
_rule("pred_string_order_false", 'find n: Call where n.name() < "z" or n.line() == 2', "kind = 'Call' AND line = 2")
_rule("pred_in_list", 'find n: Node where n.text() in ["R", "1-URGENT"]', "text IN ('R', '1-URGENT')")
_rule("pred_in_list_null", 'find n: Decl where n.text() in ["x", null]', "kind = 'MethodDef'")
_rule("pred_in_regex", "find n: Call where n.name() in /ar.*[ko]$/i", "kind = 'Call' AND regexp_matches(name, '(?i)ar.*[ko]$')")
_rule("pred_in_substring", 'find n: Call where n.text() in "RA" and n.line() == 1', "kind = 'Call' AND contains('RA', text) AND line = 1")
_rule("pred_null_ne", 'find n: Node where n.name() != "x" and n.kind() in ["Loop", "File"]', "kind IN ('Loop', 'File')")
_rule("pred_matches", 'find n: Node where n matches Call { text: "R", line: 2 }', "kind = 'Call' AND text = 'R' AND line = 2")
_rule(
    "pred_user_predicate", "find n: Call where flagged(n) and not early(n)", "kind = 'Call' AND text = 'N' AND line >= 4",
    'pred flagged(c: Call) { c.text() == "N" } pred early(c: Call) = c.line() < 4',
)
_rule("pred_undefined_false", "find n: Loop where nothing(n) or n.text() == \"5-LOW\"", "kind = 'Loop' AND text = '5-LOW'")
_rule("pred_language", 'languages: ["c", "go"] find n: Loop', "kind = 'Loop' AND file IN ('r0', 'r2', 'r4')")
# trees
_P = "JOIN nodes p ON n.parent_id = p.id"
_rule("tree_parent", 'find n: Call where n.parent().kind() == "Loop" and n.parent().parent().kind() == "MethodDef"', "n.kind = 'Call' AND p.kind = 'Loop'", table=f"nodes n {_P}", written=True)
_rule("tree_let", 'find n: Call where let p = n.parent() in p.text() == "2-HIGH" and p.kind() == "Block"', "n.kind = 'Call' AND p.text = '2-HIGH' AND p.kind = 'Block'", table=f"nodes n {_P}", written=True)
_rule("tree_function", 'find n: Call where n.function_id().name() in /7$/', "n.kind = 'Call' AND f.name LIKE '%7'", table="nodes n JOIN nodes f ON n.function_id = f.id", written=True)
_rule("tree_child", 'find n: Stmt where n.child(1).text() == "A"', "n.kind IN ('Loop', 'Conditional', 'Block') AND c.line = 2 AND c.text = 'A'", table="nodes n JOIN nodes c ON c.parent_id = n.id", children=True, written=True)
_rule("tree_arg", 'find n: Stmt where n.arg(0).arg_count() == 7', "n.kind IN ('Loop', 'Conditional', 'Block') AND c.line = 1 AND c.argument_count = 7", table="nodes n JOIN nodes c ON c.parent_id = n.id", children=True, written=True)
_rule("tree_ancestor", 'find n: Call where n.ancestor("namespace").name() == "NATION_03" or n.ancestor("MethodDef").name() in /5$/', "n.kind = 'Call' AND (s.name = 'NATION_03' OR f.name LIKE '%5')", table="nodes n JOIN nodes f ON n.function_id = f.id JOIN nodes s ON f.parent_id = s.id", written=True)
_rule("tree_has_ancestor", 'find n: Call where n.has_ancestor("conditional")', "n.kind = 'Call' AND p.kind = 'Conditional'", table=f"nodes n {_P}", written=True)
_rule("tree_has_descendant", 'find n: MethodDef where not n.has_descendant("loop")', "n.kind = 'MethodDef' AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.parent_id = n.id AND p.kind = 'Loop')", written=True)
_rule("tree_no_parent", "find n: Node where n.parent() == null", "parent_id IS NULL")
_add(
    "tree_depth",
    f"WITH RECURSIVE {views.TREE_SQL}, c AS (SELECT id, parent_id AS anc, 1 AS depth FROM nodes WHERE parent_id IS NOT NULL UNION ALL "
    "SELECT c.id, n.parent_id, depth + 1 FROM c JOIN nodes n ON c.anc = n.id WHERE n.parent_id IS NOT NULL) "
    "SELECT depth::BIGINT AS depth, count(*) AS n FROM c GROUP BY depth",
)(lambda spark, sf_dir: views.tree(spark, sf_dir, written=True).ancestry.groupBy("depth").agg(F.count(F.lit(1)).alias("n")))
# joins and quantifiers
_add("join_ancestor", f"WITH {views.TREE_SQL} SELECT 'big-open' AS rule_id, 'high' AS severity, n.file, o.id AS a, n.id AS b FROM nodes n JOIN nodes o ON n.parent_id = o.id WHERE o.kind = 'Conditional' AND n.argument_count >= 1")(flagship)
_rule("join_same_function", 'find n: Conditional, l: Loop where n.same_function(l) and n.text() == "1-URGENT" and l.text() == "5-LOW"', "n.kind = 'Conditional' AND l.kind = 'Loop' AND n.text = '1-URGENT' AND l.text = '5-LOW'", b="l.id", table="nodes n JOIN nodes l ON n.function_id = l.function_id")
_rule("join_identity", "find n: Loop, m: Stmt where n.id() == m.id() and m.line() == 1", "n.kind = 'Loop'", b="n.id")
_rule("quant_exists", 'find n: MethodDef where exists(l: Loop | l.same_function(n) and l.text() == "5-LOW")', "n.kind = 'MethodDef' AND EXISTS (SELECT 1 FROM nodes l WHERE l.function_id = n.id AND l.kind = 'Loop' AND l.text = '5-LOW')")
_rule("quant_forall", 'find n: MethodDef where forall(l: Conditional | not l.same_function(n) or l.text() != "5-LOW")', "n.kind = 'MethodDef' AND NOT EXISTS (SELECT 1 FROM nodes l WHERE l.function_id = n.id AND l.kind = 'Conditional' AND l.text = '5-LOW')")
_rule("quant_or", 'find n: Loop where n.text() == "1-URGENT" or exists(c: Call | c.has_ancestor(n.id()) and c.arg_count() == 7)', "n.kind = 'Loop' AND (n.text = '1-URGENT' OR EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.id AND c.argument_count = 7))", written=True)
_rule("quant_nested", 'find n: MethodDef where exists(l: Loop | l.same_function(n) and exists(c: Call | c.has_ancestor(l.id()) and c.same_function(n) and c.text() == "R"))', "n.kind = 'MethodDef' AND EXISTS (SELECT 1 FROM nodes l JOIN nodes c ON c.parent_id = l.id WHERE l.function_id = n.id AND l.kind = 'Loop' AND c.text = 'R')", written=True)
# control flow
_FLOW_NODES = views.FLOW_SQL + ", nodes AS (SELECT 'events' AS file, e.event_id AS id, e.t AS name, e.fn, e.k, b.o FROM e JOIN blocks b ON e.fn = b.fn AND e.t = b.t)"
_PAIR = "nodes n JOIN nodes m ON n.fn = m.fn"
for _name, _method, _test in (
    ("cfg_dominates", "dominates", "EXISTS (SELECT 1 FROM dom d WHERE d.fn = n.fn AND d.a = n.o AND d.b = m.o)"),
    ("cfg_reaches", "cfg_reaches", "EXISTS (SELECT 1 FROM reach d WHERE d.fn = n.fn AND d.a = n.o AND d.b = m.o)"),
    ("cfg_same_block", "same_block", "n.o = m.o"),
):
    _rule(_name, f'find n: Call, m: Call where n.{_method}(m) and n.name() == "click" and n.line() < m.line()', f"n.name = 'click' AND n.k < m.k AND {_test}", view=views.flow, prefix=_FLOW_NODES, b="m.id", table=_PAIR)
_rule("cfg_exception_path", "find n: Call where n.in_exception_path()", "(n.fn, n.o) IN (SELECT r.fn, r.b FROM reach r JOIN alledges x ON r.fn = x.fn AND r.a = x.dst WHERE x.exc)", view=views.flow, prefix=_FLOW_NODES)
_rule("cfg_without", 'find n: Call, m: Call, w: Call where n.cfg_reaches_without(m, w) and n.same_function(m) and n.same_function(w) and n.line() == 1 and w.name() == "view" and w.line() == 2',
    "n.k = 1 AND w.name = 'view' AND w.k = 2 AND EXISTS (SELECT 1 FROM away v WHERE v.fn = n.fn AND v.w = w.o AND v.n = m.o)",
    view=views.flow, prefix=_FLOW_NODES + ", away AS (SELECT b.fn, b.o AS w, 0::BIGINT AS n FROM blocks b UNION SELECT v.fn, v.w, x.dst FROM away v JOIN edges x ON v.fn = x.fn AND v.n = x.src WHERE x.dst <> v.w)",
    b="m.id", table="nodes n JOIN nodes m ON n.fn = m.fn JOIN nodes w ON n.fn = w.fn")


def _fact(name: str, fact: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.flow(spark, sf_dir).flow_facts.where(F.col("fact") == fact).select("function", "a", "b")

    _add(name, f"WITH RECURSIVE {views.FLOW_SQL}{sql}")(run)


_END = ", stop AS (SELECT fn, max(o) + 1 AS z FROM blocks GROUP BY fn), back AS (SELECT fn, dst AS src, src AS dst FROM edges UNION SELECT b.fn, s.z, b.o FROM blocks b JOIN stop s ON b.fn = s.fn WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.fn = b.fn AND x.src = b.o)), blive AS (SELECT fn, z AS n FROM stop UNION SELECT v.fn, x.dst FROM blive v JOIN back x ON v.fn = x.fn AND v.n = x.src), bavoid AS (SELECT b.fn, b.o AS w, s.z AS n FROM blocks b JOIN stop s ON b.fn = s.fn UNION SELECT v.fn, v.w, x.dst FROM bavoid v JOIN back x ON v.fn = x.fn AND v.n = x.src WHERE x.dst <> v.w)"
_fact("cfg_post_dominates", "postdom", _END + " SELECT fn AS \"function\", o AS a, o AS b FROM blocks UNION SELECT l.fn, p.o, l.n FROM blive l JOIN blocks p ON l.fn = p.fn JOIN blocks q ON l.fn = q.fn AND l.n = q.o WHERE EXISTS (SELECT 1 FROM blive x WHERE x.fn = p.fn AND x.n = p.o) AND NOT EXISTS (SELECT 1 FROM bavoid v WHERE v.fn = p.fn AND v.w = p.o AND v.n = l.n)")
_fact("cfg_frontier", "frontier", " SELECT DISTINCT x.fn AS \"function\", d.a AS a, x.dst AS b FROM edges x JOIN dom d ON d.fn = x.fn AND d.b = x.src WHERE d.a = x.dst OR NOT EXISTS (SELECT 1 FROM dom e2 WHERE e2.fn = x.fn AND e2.a = d.a AND e2.b = x.dst)")
_fact("cfg_scc", "scc", " SELECT a.fn AS \"function\", a.a AS a, min(a.b) AS b FROM reach a JOIN reach z ON a.fn = z.fn AND a.a = z.b AND a.b = z.a GROUP BY a.fn, a.a")
_fact("cfg_loop_no_exit", "noexit", ", scc AS (SELECT a.fn, a.a, min(a.b) AS c FROM reach a JOIN reach z ON a.fn = z.fn AND a.a = z.b AND a.b = z.a GROUP BY a.fn, a.a), cyc AS (SELECT DISTINCT x.fn, s.c FROM edges x JOIN scc s ON s.fn = x.fn AND s.a = x.src JOIN scc t ON t.fn = x.fn AND t.a = x.dst WHERE s.c = t.c), ext AS (SELECT DISTINCT x.fn, s.c FROM edges x JOIN scc s ON s.fn = x.fn AND s.a = x.src JOIN scc t ON t.fn = x.fn AND t.a = x.dst WHERE s.c <> t.c) SELECT s.fn AS \"function\", s.a AS a, s.c AS b FROM scc s JOIN cyc USING (fn, c) WHERE NOT EXISTS (SELECT 1 FROM ext WHERE ext.fn = s.fn AND ext.c = s.c)")
_fact("cfg_in_loop", "loop", ", heads AS (SELECT DISTINCT x.fn, x.dst AS h FROM edges x JOIN dom d ON d.fn = x.fn AND d.a = x.dst AND d.b = x.src), depth AS (SELECT fn, b, count(*) AS n FROM dom GROUP BY fn, b), near AS (SELECT d.fn, d.b, arg_max(d.a, p.n) AS h FROM dom d JOIN heads h ON h.fn = d.fn AND h.h = d.a JOIN depth p ON p.fn = d.fn AND p.b = d.a GROUP BY d.fn, d.b) SELECT n.fn AS \"function\", n.b AS a, n.h AS b FROM near n WHERE EXISTS (SELECT 1 FROM reach r WHERE r.fn = n.fn AND r.a = n.b AND r.b = n.h)")
# data flow and taint
_D = f"WITH RECURSIVE {views.DATA_SQL}"
_R = ", r AS (SELECT s_suppkey * 8 + 5 AS a, s_suppkey * 8 + 5 AS b FROM supplier WHERE s_acctbal < 0 UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src{})"


@_add("dfg_flows_to", _D + " SELECT DISTINCT src AS a, dst AS b FROM edges WHERE v = 'A'")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    return dfg.flows_to(g.only(dfg_edges=g.table("dfg_edges").where("variable = 'A'"))).select("a", "b")


@_add("dfg_reaches", _D + _R.format("") + " SELECT a, b FROM r")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    return dfg.reaches(g, g.nodes.where("kind = 'Call' AND text = 'debt'").select("file", F.col("id").alias("a"))).select("a", "b")


@_add("dfg_backward", _D + ", r AS (SELECT c_custkey * 8 + 2 AS a, c_custkey * 8 + 2 AS b FROM customer WHERE c_acctbal < 0 UNION SELECT r.a, e.src FROM r JOIN edges e ON r.b = e.dst) SELECT a, b FROM r")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    broke = views.read(spark, sf_dir, "customer").where("c_acctbal < 0")
    return dfg.reached_from(g, broke.select(F.lit("d").alias("file"), (F.col("c_custkey") * 8 + 2).alias("a"))).select("a", "b")


@_add("dfg_neighbours", _D + ", n AS (SELECT src AS a, dst AS b, 'successor' AS side FROM edges UNION SELECT dst, src, 'predecessor' FROM edges) SELECT a, side, count(*) AS n, min(b) AS least FROM n GROUP BY a, side")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    out = dfg.successors(g).withColumn("side", F.lit("successor")).unionByName(dfg.predecessors(g).withColumn("side", F.lit("predecessor")))
    return out.groupBy("a", "side").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least"))


# subtrees: the condition a != 0 or a == 0 holds a use below it
@_add("dfg_flows_into_trees", "SELECT p_partkey * 64 + 3 AS a, p_partkey * 64 + t AS b FROM part, (VALUES (17), (13), (22), (21), (20), (26), (25), (24), (43), (39), (38), (30), (31)) x(t) UNION ALL SELECT p_partkey * 64 + 2, p_partkey * 64 + t FROM part, (VALUES (17), (13), (22), (21), (20), (26), (25), (24), (43), (39), (38), (30), (31)) x(t) UNION ALL SELECT p_partkey * 64 + a, p_partkey * 64 + t FROM part, (VALUES (3, 32), (3, 33), (3, 34), (2, 32), (2, 33), (2, 34)) x(a, t) WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey * 64 + a, p_partkey * 64 + 36 FROM part, (VALUES (3), (2)) x(a) WHERE p_partkey % 2 = 0")
def _(spark, sf_dir):
    g = views.code(spark, sf_dir)
    out = dfg.flows_to(g.only(dfg_edges=g.table("dfg_edges").where("variable = 'a'")))
    # all but the function itself, which holds every flow
    inner = g.nodes.where("kind <> 'MethodDef'").select("file", "id")
    out = out.join(inner.withColumnRenamed("id", "a"), ["file", "a"]).join(inner.withColumnRenamed("id", "b"), ["file", "b"])
    return out.select("a", "b")


@_add("dfg_barrier", _D + _R.format(" WHERE e.dst NOT IN (SELECT p_partkey * 8 + 6 FROM part WHERE p_size > 25)") + " SELECT a, b FROM r")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    wall = g.nodes.where("kind = 'Assign' AND line > 25").select("file", F.col("id").alias("node"))
    seeds = g.nodes.where("kind = 'Call' AND text = 'debt'").select("file", F.col("id").alias("a"))
    return dfg.reaches(g, seeds, wall).select("a", "b")


@_add("dfg_def_use", _D + " SELECT DISTINCT src AS a FROM edges WHERE v = 'R' AND src IN (SELECT dst FROM edges WHERE v = 'N')")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    return dfg.labelled(g, "src", "R").join(dfg.labelled(g, "dst", "N"), ["file", "a"], "left_semi").select("a")


_TAINT = """
source debt = find n: Call where n.text() == "debt"
sink buyer = {{ kind: Return, name: "BUILDING" }}
sanitizer large = find p: Assign where p.line() > 25
rule "flow" {{ severity: critical taint {{ sources: [debt] sinks: [buyer] sanitizers: [{0}] max_call_depth: {1} }} }}
"""
_TAINT_SQL = _D + ", h AS (SELECT s_suppkey * 8 + 5 AS a, s_suppkey * 8 + 5 AS b FROM supplier WHERE s_acctbal < 0 UNION SELECT h.a, e.dst FROM h JOIN edges e ON h.b = e.src WHERE {}) SELECT 'flow' AS rule_id, 'critical' AS severity, 'd' AS file, a, c_custkey * 8 + 2 AS b FROM h JOIN customer ON b = c_custkey * 8 + 2 WHERE c_mktsegment = 'BUILDING'"


def _ends(findings: DataFrame) -> DataFrame:
    last = F.element_at("matched_nodes", -1)
    return findings.select("rule_id", "severity", "file", F.get("matched_nodes", F.lit(0)).alias("a"), last.alias("b"))


_add("taint_basic", _TAINT_SQL.format("true"))(lambda s, d: _ends(run_rules(views.data(s, d), _TAINT.format("", 10))))
_add("taint_sanitized", _TAINT_SQL.format("e.dst NOT IN (SELECT p_partkey * 8 + 6 FROM part WHERE p_size > 25)"))(lambda s, d: _ends(run_rules(views.data(s, d), _TAINT.format("large", 10))))
# one hop reaches parts but no customers
_BOUNDED = _TAINT.replace("sinks: [buyer]", "sinks: [buyer, stock]").replace("rule", "sink stock = find p: Assign where p.line() > 40 rule", 1)
_add("taint_bounded", _D + " SELECT DISTINCT 'flow' AS rule_id, 'critical' AS severity, 'd' AS file, src AS a, dst AS b FROM edges JOIN supplier ON src = s_suppkey * 8 + 5 JOIN part ON dst = p_partkey * 8 + 6 WHERE s_acctbal < 0 AND p_size > 40")(lambda s, d: _ends(run_rules(views.data(s, d), _BOUNDED.format("", 0))))


@_add("taint_path", _D + ", t AS (SELECT e1.src AS a, e3.dst AS b, min(e2.dst) AS m FROM edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src JOIN supplier ON e1.src = s_suppkey * 8 + 5 JOIN customer ON e3.dst = c_custkey * 8 + 2 WHERE s_acctbal < 0 AND c_mktsegment = 'BUILDING' GROUP BY 1, 2) SELECT a, b, 4::BIGINT AS n, m AS before_last FROM t")
def _(spark, sf_dir):
    f = run_rules(views.data(spark, sf_dir), _TAINT.format("", 10))
    m = F.col("matched_nodes")
    return f.select(F.get(m, F.lit(0)).alias("a"), F.element_at(m, -1).alias("b"), F.size(m).cast("long").alias("n"), F.element_at(m, -2).alias("before_last"))


# analyses
_CROSS = """
source given = find n: Call where n.name() == "input"
sink used = find n: Call where n.name() == "sink"
rule "crossed" { severity: high taint { sources: [given] sinks: [used] } }
"""


@_add("taint_cross_file", "SELECT c_custkey * 8 + 4 AS a, c_custkey * 8 + 6 AS b, 3::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 0")
def _(spark, sf_dir):
    m = F.col("matched_nodes")
    found = run_rules(views.library(spark, sf_dir), _CROSS)
    return found.select(F.get(m, F.lit(0)).alias("a"), F.element_at(m, -1).alias("b"), F.size(m).cast("long").alias("n"))


@_add("taint_registry", "SELECT c_custkey * 8 + 4 AS a, c_custkey * 8 + 5 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 0")
def _(spark, sf_dir):
    sets = taint.registry([("own.sources", "input", []), ("own.sinks", "sink", [0])])
    text = 'rule "named" { severity: high taint { sources: ["own.sources"] sinks: ["own.sinks"] } }'
    m = F.col("matched_nodes")
    return run_rules(views.library(spark, sf_dir), text, sets).select(F.get(m, F.lit(0)).alias("a"), F.element_at(m, -1).alias("b"))


@_add("ana_alias", _D + ", p AS (SELECT DISTINCT src AS x, dst AS t FROM edges WHERE v = 'R') SELECT DISTINCT m.x AS a, n.x AS b FROM p m JOIN p n ON m.t = n.t AND m.x < n.x")
def _(spark, sf_dir):
    return analyses.may_alias(views.data(spark, sf_dir)).select("a", "b")


@_add("ana_nullability", _D + ", r AS (SELECT s_suppkey * 8 + 5 AS a, s_suppkey * 8 + 5 AS b, 0 AS h FROM supplier WHERE s_suppkey % 10 = 1 UNION SELECT r.a, e.dst, h + 1 FROM r JOIN edges e ON r.b = e.src WHERE e.v <> 'R') SELECT b AS node, arg_min(a, (h, a)) AS source FROM r GROUP BY b")
def _(spark, sf_dir):
    g = views.data(spark, sf_dir)
    name = F.when((F.col("kind") == "Call") & ((F.col("id") - 5) / 8 % 10 == 1), "malloc").otherwise(F.col("name"))
    return analyses.nullability(g.only(nodes=g.nodes.withColumn("name", name))).select("node", "source")


@_add("ana_callees", "WITH k AS (SELECT p_partkey AS id, p_name AS key, 1 AS r FROM part UNION ALL SELECT p_partkey, p_brand || '.' || p_name, 0 FROM part), c AS (SELECT p_partkey AS n, p_name AS s, CASE WHEN p_size > 25 THEN p_brand || '.' || p_name END AS q FROM part), h AS (SELECT c.n, k.id, CASE WHEN k.key = c.q THEN 0 ELSE 1 END AS ask, k.r FROM c JOIN k ON k.key = c.q OR k.key = c.s) SELECT n AS call_node, arg_min(id, (ask, r, id)) AS target FROM h GROUP BY n")
def _(spark, sf_dir):
    p = views.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(".", "p_brand", "p_name").alias("q"), "p_size")
    calls = p.select(F.lit("f").alias("file"), F.col("p_partkey").alias("call_node"), F.col("p_name").alias("callee_name"), F.when(F.col("p_size") > 25, F.col("q")).alias("qualified_callee"))
    names = p.select(F.lit("f").alias("file"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("q").alias("qualified_name"))
    return analyses.resolve_callees(calls, names).select("call_node", "target")


@_add("ana_class_closure", "WITH RECURSIVE e AS (SELECT c_custkey AS x, c_custkey // 3 AS y FROM customer WHERE c_custkey >= 3), r AS (SELECT x, y, 1 AS h FROM e UNION ALL SELECT r.x, e.y, h + 1 FROM r JOIN e ON r.y = e.x) SELECT x::VARCHAR AS child, y::VARCHAR AS ancestor, h::BIGINT AS hops FROM r")
def _(spark, sf_dir):
    from quillgraph.plans.graph import Graph

    c = views.read(spark, sf_dir, "customer").where("c_custkey >= 3")
    t = c.select(F.lit("f").alias("file"), F.col("c_custkey").cast("string").alias("child"), F.floor(F.col("c_custkey") / 3).cast("string").alias("parent"))
    return analyses.class_closure(Graph(spark, {"supertypes": t})).select("child", "ancestor", "hops")


@_add("ana_prune", f"WITH {views.TREE_SQL}, x AS (SELECT n.id AS src, p.parent_id AS dst FROM nodes n JOIN nodes p ON n.parent_id = p.id WHERE n.kind = 'Call'), m AS (SELECT CASE WHEN s.kind = 'Call' THEN s.parent_id ELSE s.id END AS src, CASE WHEN d.kind = 'Call' THEN d.parent_id ELSE d.id END AS dst FROM x JOIN nodes s ON x.src = s.id JOIN nodes d ON x.dst = d.id) SELECT DISTINCT src, dst FROM m WHERE src <> dst")
def _(spark, sf_dir):
    g = views.tree(spark, sf_dir)
    n = g.nodes.where("kind = 'Call'").select("file", F.col("id").alias("src"), F.col("parent_id").alias("id"))
    edges = n.join(g.nodes.select("file", "id", F.col("parent_id").alias("dst")), ["file", "id"]).select("file", "src", "dst")
    return analyses.prune(g, edges, "Call").select("src", "dst")


@_add("ana_anonymize", f"WITH {views.TREE_SQL}, f AS (SELECT file, name, row_number() OVER (PARTITION BY file ORDER BY min(id), name) AS k FROM nodes WHERE name IS NOT NULL GROUP BY file, name) SELECT n.id AS id, 'var' || k AS name FROM nodes n JOIN f ON n.file = f.file AND n.name = f.name")
def _(spark, sf_dir):
    return analyses.anonymize(views.tree(spark, sf_dir)).select("id", "name")


# scalar methods over source-like functions, one a part (views.code)
def _code(name: str, find: str, *cases: tuple[str, str] | tuple[str, str, str], extra: str = ""):
    """cases: (SQL of the first binding's number, where, maybe the second's number)."""
    text = f'{extra} rule "{name}" {{ severity: low {find} }}'
    parts = [f"SELECT '{name}' AS rule_id, 'low' AS severity, p_brand AS file, p_partkey * 64 + {c[0]} AS a, {f'p_partkey * 64 + {c[2]}' if len(c) > 2 else 'NULL::BIGINT'} AS b FROM part WHERE {c[1]}" for c in cases]
    _add(name, " UNION ALL ".join(parts))(lambda spark, sf_dir: _flat(run_rules(views.code(spark, sf_dir), text)))


def _each(where: str, *numbers: int) -> list[tuple[str, str]]:
    return [(str(n), where) for n in numbers]


_ODD, _EVEN = "p_partkey % 2 = 1", "p_partkey % 2 = 0"
_code("node_texts", 'find n: MethodDef where n.namespace() == "Brand#12" and n.class_context() != null and n.visibility() == "private" and n.operator() == null', ("1", "p_brand = 'Brand#12' AND p_size <= 25"))
_code("node_operator", 'find n: Expr where n.operator() in ["!", "<"]', ("7", "true"), ("14", "true"), ("31", _ODD))
_code("node_file", 'find n: LocalDef where n.file() in /2$/', ("5", "p_brand LIKE '%2'"))
_code("node_is_some", "find n: LocalDef where n.is_some() and not n.is_none() and not n.child(0).is_some()", ("5", "true"))
_code("node_return_type", "find n: MethodDef where n.return_type() in /[A-M]/ and n.return_value().line() == n.id().line()", ("1", "regexp_matches(p_type, '[A-M]')"))
_code("node_flags", "find n: MethodDef where n.is_constructor() or n.is_destructor() or n.is_virtual()", ("1", "p_size = 1 OR p_size = 2 OR p_size > 40"))
_code("node_base_classes", 'find n: MethodDef where n.base_classes() in /^[A-M]/ and n.implements() == n.return_type()', ("1", "regexp_matches(p_type, '^[A-M]')"))
_code("lit_values", 'find n: Literal where n.lit_kind() == "Int" and n.int_value() > 30 or n.string_value() == "true"', *_each("p_size > 30", 8, 12, 37, 41), ("15", "p_size > 40"))
_code("tree_children", "find n: Node where n.children().lit_kind() == \"Int\" and n.receiver().int_value() == 7", *_each("p_size = 7", 7, 11, 40))
_code("tree_descendant", 'find n: Conditional where n.descendant("call").name() == "malloc" and n.descendant("literal").int_value() > 40', ("6", "p_size > 40"))
_code("tree_has_arg", "find n: Call, m: Literal where n.has_arg(m) and m.int_value() == 4 and n.same_function(m)", ("11", "p_size = 4", "12"), ("40", "p_size = 4", "41"), ("40", "true", "42"))
_code("call_site_names", 'find n: Call where n.callee_name() == "malloc" and n.qualified_callee() == "std::malloc"', ("11", "p_size > 25"))
_code("call_site_kind", 'find n: Call where n.callee_kind() == "unknown" and n.arg_count() == 1', *_each("true", 25, 39), ("33", _ODD))
_code("name_refers_to", 'find n: Identifier where n.refers_to().name() == "buf" or n.refers_to().name() == "a" and n.parent().kind() == "Loop"', *_each("true", 16, 17))
_code("call_refers_to", "find n: Call where n.refers_to().kind() == \"MethodDef\"", ("11", "p_size > 25"))
_code("param_count", "find n: MethodDef where n.param_count() == 2", ("1", "p_size > 25"))
_code("param_nth", 'find n: MethodDef where n.param(1).name() == "b" or n.param(0).name() == "b"', ("1", "p_size > 25"))
_code("eval_int", "find n: Expr where n.eval_int() > 40 and n.lit_kind() != null", *_each("p_size > 40", 8, 12, 37, 41))
_code("eval_bool", 'find n: Expr where n.eval_bool() == true and n.operator() != null', ("7", "p_size < 25"), ("14", "p_size <= 40"))
_code("is_const_expr", 'find n: Expr where not n.is_const_expr() and n.operator() != null', ("21", "true"), ("31", "true"), ("32", _ODD))
_code("alloc_size", "find n: Node where n.alloc_size() == 28", *_each("p_size = 28", 5, 11), ("40", "p_size = 7"))
_code("has_known_size", "find n: Call where n.has_known_size() and n.alloc_size() <= 12", ("11", "p_size <= 12"), ("40", "p_size <= 3"))
_code("may_be_null", "find n: Node where n.may_be_null()", *_each("true", 11, 40), ("5", _EVEN))
_code("null_source", 'find n: LocalDef where n.null_source().name() == "malloc"', ("5", _EVEN))
_code("is_pointer", 'find n: Call where n.is_pointer() and n.points_to().name() == "buf" and n.alias_target().kind() == "LocalDef"', ("11", _ODD))
_code("basic_block", "find n: Node where n.basic_block() >= 3", *_each("true", 14, 16, 40))
_code("branch_condition", "find n: Call where n.branch_condition().eval_int() == 1", ("11", "p_size < 25"))
_code("loop_condition", 'find n: Identifier where n.loop_condition().operator() == "!"', *_each("true", 16, 17))
_code("guard_evals_true", "find n: Expr where n.guard_evals_true() and n.kind() in [\"Call\", \"Identifier\"]", ("11", "p_size < 25"), *_each("p_size <= 40", 16, 17))
_code("guard_evals_false", "find n: Call where n.guard_evals_false()", ("11", "p_size >= 25"))
_code("in_dead_branch", "find n: Node where n.in_dead_branch()", ("11", "p_size >= 25"), ("22", "p_size < 25"), ("16", "p_size > 40"), ("40", "p_size <= 40"))
_code("cfg_reaches_feasible", 'find n: BinaryOp, m: Call where n.cfg_reaches_feasible(m) and m.name() == "calloc"', ("7", "p_size > 40", "40"))
_code("loop_const_no_exit", "find n: Identifier where n.loop_has_no_exit()", ("16", "p_size <= 40"))
_code("excludes_zero", 'find g: Conditional, v: ParamDef, t: Call where g.same_function(v) and g.same_function(t) and t.name() == "use" and v.name() == "a" and g.excludes_zero(v, t)', ("20", _ODD, "3"), ("20", _EVEN, "3"))
_code("bounds_value", 'find g: Conditional, v: ParamDef, t: Call where g.same_function(v) and g.same_function(t) and t.has_ancestor(g.id()) and v.name() == "a" and g.bounds_value(v, t, 20)', ("30", f"{_ODD} AND p_size <= 21", "3"))
_code("bounds_declared", 'find g: Conditional, v: ParamDef, t: Call, d: LocalDef where g.same_function(v) and g.same_function(t) and g.same_function(d) and t.has_ancestor(g.id()) and v.name() == "a" and g.bounds_value(v, t, d)', ("30", _ODD, "3"))
_code("meta_cpp", "find n: MethodDef where n.cpp_meta.is_virtual and n.cpp_meta().base_classes == n.return_type()", ("1", "p_size > 25"))
_code("meta_go", "find n: MethodDef where n.go_meta.is_exported == false and n.go_meta.package_name == n.name()", ("1", "p_size <= 25"))
_code("meta_python", "find n: MethodDef where n.python_meta.is_async and n.python_meta.decorators == n.name()", ("1", "p_size < 5"))
_code("meta_java", "find n: Node where n.java_meta.is_final and n.java_meta.annotations == null and n.java_meta.package_name == null", ("1", "p_size > 30"))
_code("meta_js", "find n: MethodDef where n.js_meta.is_arrow or n.js_meta.module_kind == \"none\"", ("1", "p_size = 7"))
_code("meta_ts", "find n: MethodDef where n.ts_meta.enum_is_const and n.ts_meta.access_modifier != null", ("1", "p_size = 8"))
_code("meta_rust", "find n: Node where n.rust_meta.is_unsafe == false and n.rust_meta.lifetimes == n.return_type()", ("1", "p_size >= 9"))
_code("pred_in_let", "find n: MethodDef where let p = n.param(0) in first(p) and n matches MethodDef { name: n.name() }", ("1", "true"), extra='pred first(p: ParamDef) = p.name() == "a"')


# construction from syntax trees (views.code has the shape of each function)
def _built(spark, sf_dir):
    return construct.with_control_flow(views.code(spark, sf_dir))


_ARMS = "(0, 1, 0), (0, 2, 1), (1, 2, 0), (2, 3, 0), (3, 4, 0), (3, 5, 1), (4, 3, 0), (5, 6, 0), (5, 7, 1), (6, 7, 0), (7, 8, 0), (7, 9, 1), (8, 9, 0), (9, 10, 0)"


@_add("build_cfg_edges", f"SELECT p_brand AS file, p_partkey * 64 + 1 AS \"function\", s::BIGINT AS src, t::BIGINT AS dst, a::BIGINT AS arm, 'normal' AS kind FROM part, (VALUES {_ARMS}) x(s, t, a)")
def _(spark, sf_dir):
    return _built(spark, sf_dir).table("cfg_edges")


_HELD = "(0, 5), (0, 6), (0, 7), (0, 8), (0, 9), (1, 11), (1, 12), (2, 13), (3, 14), (3, 15), (4, 16), (4, 17), (5, 20), (5, 21), (5, 22), (5, 23), (6, 25), (6, 26), (7, 30), (7, 31), (7, 37), (8, 39), (8, 43), (9, 40), (9, 41), (9, 42)"


@_add("build_block_nodes", f"SELECT p_brand AS file, p_partkey * 64 + n AS node_id, b::BIGINT AS block_ord FROM part, (VALUES {_HELD}) x(b, n) UNION ALL SELECT p_brand, p_partkey * 64 + n, 7 FROM part, (VALUES (32), (33), (34), (35)) x(n) WHERE p_partkey % 2 = 1 UNION ALL SELECT p_brand, p_partkey * 64 + 36, 7 FROM part WHERE p_partkey % 2 = 0")
def _(spark, sf_dir):
    return _built(spark, sf_dir).table("block_nodes").select("file", "node_id", "block_ord")


@_add("build_data_flow", "SELECT p_brand AS file, p_partkey * 64 + s AS src, p_partkey * 64 + t AS dst, v AS variable, 'REACHING_DEF' AS edge_type FROM part, (VALUES (3, 17, 'a'), (3, 22, 'a'), (3, 26, 'a'), (3, 43, 'a'), (5, 16, 'buf')) x(s, t, v) UNION ALL SELECT p_brand, p_partkey * 64 + 3, p_partkey * 64 + CASE p_partkey % 2 WHEN 1 THEN 34 ELSE 36 END, 'a', 'REACHING_DEF' FROM part")
def _(spark, sf_dir):
    return construct.data_flow(_built(spark, sf_dir))


# programs: who calls whom
_NEXT = "k + 64 IN (SELECT p_partkey FROM part)"
_PARTS = "p AS (SELECT p_partkey AS k, 'p' || p_partkey % 64 AS file FROM part)"


@_add("call_keys", f"WITH {_PARTS}, a AS (SELECT file, 'f' || k AS key, k * 64 + 1 AS id FROM p UNION ALL SELECT file, 'C' || k || '::f' || k, k * 64 + 1 FROM p UNION ALL SELECT file, 'C' || k, k * 64 + 31 FROM p WHERE k % 2 = 1 UNION ALL SELECT file, 'C' || k || '::C' || k, k * 64 + 31 FROM p WHERE k % 2 = 1 UNION ALL SELECT file, 'run', k * 64 + 32 FROM p WHERE k % 3 = 0 UNION ALL SELECT file, 'C' || k || '::run', k * 64 + 32 FROM p WHERE k % 3 = 0) SELECT file, key, min(id) AS id FROM a GROUP BY file, key")
def _(spark, sf_dir):
    return calls.definition_keys(views.program(spark, sf_dir))


@_add("call_graph", f"WITH {_PARTS} SELECT file, k * 64 + 1 AS caller, 'f' || (k + 64) AS callee_name, k * 64 + 3 AS call, CASE WHEN {_NEXT} THEN (k + 64) * 64 + 1 END AS target FROM p")
def _(spark, sf_dir):
    return calls.call_graph(views.program(spark, sf_dir))


@_add("call_callers", f"WITH {_PARTS} SELECT file, (k + 64) * 64 + 1 AS target, k * 64 + 1 AS caller FROM p WHERE {_NEXT}")
def _(spark, sf_dir):
    out = calls.called_by(calls.call_graph(views.program(spark, sf_dir)))
    return out.select("file", "target", F.explode("callers").alias("caller"))


@_add("call_arrays", f"WITH {_PARTS} SELECT file, k * 64 + 15 AS call, k * 64 + 1 AS target FROM p UNION ALL SELECT file, k * 64 + 15, (k + 64) * 64 + 1 FROM p WHERE {_NEXT}")
def _(spark, sf_dir):
    return calls.array_dispatch(views.program(spark, sf_dir))


@_add("call_fields", f"WITH {_PARTS} SELECT file, k * 64 + 23 AS call, k * 64 + 1 AS target FROM p")
def _(spark, sf_dir):
    return calls.field_dispatch(views.program(spark, sf_dir))


@_add("call_constructors", f"WITH {_PARTS} SELECT file, k * 64 + 30 AS call, CASE k % 2 WHEN 1 THEN 'C' || k || '::C' || k ELSE 'C' || k END AS callee_name, CASE k % 2 WHEN 1 THEN k * 64 + 31 END AS target FROM p")
def _(spark, sf_dir):
    return calls.constructor_calls(views.program(spark, sf_dir))


@_add("call_classes", f"WITH RECURSIVE {_PARTS}, up AS (SELECT k AS c, k AS a, 0 AS h FROM p UNION ALL SELECT c, a % 64 + 64 * (a // 64 // 2), h + 1 FROM up WHERE a >= 64 AND a % 64 + 64 * (a // 64 // 2) <> a), first AS (SELECT c AS k, arg_min(a, h) AS t FROM up WHERE a % 3 = 0 AND a IN (SELECT k FROM p) GROUP BY c) SELECT 'p' || k % 64 AS file, k * 64 + 3 AS call, t * 64 + 32 AS target FROM first UNION SELECT 'p' || a % 64, a * 64 + 3, c * 64 + 32 FROM up WHERE h > 0 AND c % 3 = 0 AND a IN (SELECT k FROM p)")
def _(spark, sf_dir):
    asked = views.read(spark, sf_dir, "part").selectExpr("'p' || (p_partkey % 64) AS file", "p_partkey * 64 + 3 AS call", "'run' AS method", "'C' || p_partkey AS class")
    return calls.class_dispatch(views.program(spark, sf_dir), asked)


@_add("call_channels", f"WITH {_PARTS} SELECT a.file, a.k * 64 + 40 AS src, b.k * 64 + 42 AS dst FROM p a JOIN p b ON a.k % 640 = b.k % 640")
def _(spark, sf_dir):
    return calls.channels(views.program(spark, sf_dir)).select("file", "src", "dst")


@_add("call_summaries", f"WITH {_PARTS} SELECT file, 'f' || k AS fn_name, 'TaintReturn' AS effect, 0::BIGINT AS idx FROM p WHERE k % 2 = 1")
def _(spark, sf_dir):
    return calls.summaries(views.program(spark, sf_dir).written())


# scans of sources
_LINES = "SELECT p_brand AS file, '#define ' || replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN ' plain_' || p_size WHEN 1 THEN '(a, b)  alloc(a * b)' ELSE ' ' || p_size END AS text, p_partkey AS k FROM part"


@_add("scan_macros", f"SELECT file, regexp_extract(text, '^#define (\\w+)', 1) AS name, CASE k % 3 WHEN 1 THEN 'a,b' ELSE '' END AS params, CASE k % 3 WHEN 1 THEN 'alloc(a * b)' ELSE regexp_extract(text, '(\\S+)$', 1) END AS body, CASE k % 3 WHEN 0 THEN regexp_extract(text, '(\\S+)$', 1) WHEN 1 THEN 'alloc' END AS alias FROM ({_LINES})")
def _(spark, sf_dir):
    p = views.read(spark, sf_dir, "part")
    end = "CASE p_partkey % 3 WHEN 0 THEN ' plain_' || p_size WHEN 1 THEN '(a, b)  alloc(a * b)' ELSE ' ' || p_size END"
    return scans.macros(p.selectExpr("p_brand AS file", f"'#define ' || replace(p_name, ' ', '_') || {end} AS text")).withColumn("params", F.concat_ws(",", "params"))


@_add("scan_strings", "SELECT p_partkey AS id, replace(p_name, ' ', chr(9)) || chr(10) || '\"' || 'z' AS value, octet_length((replace(p_name, ' ', chr(9)) || chr(10) || '\"' || 'z')::BLOB)::BIGINT AS string_length FROM part")
def _(spark, sf_dir):
    from quillgraph.plans.graph import Graph

    p = views.read(spark, sf_dir, "part").select(F.lit("s").alias("file"), F.col("p_partkey").alias("id"), F.lit("Literal").alias("kind"), F.lit("String").alias("lit_kind"),
        F.concat(F.lit('b"'), F.replace("p_name", F.lit(" "), F.lit("\\t")), F.lit('\\n\\"\\z"')).alias("text"))
    return scans.string_values(Graph(spark, {"nodes": p})).select("id", "value", "string_length")


_DIFF = "p AS (SELECT p_partkey AS k, p_name AS a, replace(p_name, 'a', CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'aa' ELSE 'e' END) AS b FROM part), s AS (SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]) - 1, least(len(a), len(b))) AS st FROM p WHERE a <> b), t AS (SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) - st + 1) IF a[len(a) + 1 - i] <> b[len(b) + 1 - i]]) - 1, least(len(a), len(b)) - st) AS tail FROM s)"


@_add("scan_edits", f"WITH {_DIFF} SELECT k, st::BIGINT AS start_byte, (len(a) - tail)::BIGINT AS old_end_byte, (len(b) - tail)::BIGINT AS new_end_byte, CASE WHEN len(a) - tail = st THEN 'insert' WHEN len(b) - tail = st THEN 'delete' ELSE 'replace' END AS change, (len(b) - tail)::BIGINT AS new_end_column FROM t")
def _(spark, sf_dir):
    p = views.read(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(p_name AS binary) AS a", "CAST(replace(p_name, 'a', CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'aa' ELSE 'e' END) AS binary) AS b")
    out = p.select("k", scans.compute_edit("a", "b").alias("e")).where("e.change IS NOT NULL")
    return out.select("k", "e.start_byte", "e.old_end_byte", "e.new_end_byte", "e.change", "e.new_end_column")


# measures of runs
@_add("profile_caches", "SELECT event_type AS name, sum(user_id % 3)::BIGINT AS hits, sum(user_id % 2)::BIGINT AS misses, count(value) AS inserts, count(*) - count(value) AS evictions, max(user_id) AS bytes, CASE WHEN sum(user_id % 3) + sum(user_id % 2) > 0 THEN 100.0 * sum(user_id % 3) / (sum(user_id % 3) + sum(user_id % 2)) ELSE 0 END::DECIMAL(18, 4) AS hit_rate FROM events GROUP BY event_type")
def _(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").selectExpr("event_type AS name", "user_id % 3 AS hits", "user_id % 2 AS misses", "CAST(value IS NOT NULL AS long) AS inserts", "CAST(value IS NULL AS long) AS evictions", "user_id AS bytes")
    return profile.caches(e).withColumn("hit_rate", F.col("hit_rate").cast("decimal(18,4)"))


@_add("profile_parallel", "WITH s AS (SELECT o_orderpriority AS name, (sum(o_custkey) // count(*)) * count(*) AS total FROM orders GROUP BY 1) SELECT w.name || '/' || c.name AS label, w.total::BIGINT AS wall, c.total::BIGINT AS cpu, least(100.0, c.total / (w.total * 2) * 100)::DECIMAL(18, 4) AS efficiency FROM s w JOIN s c ON w.name <> c.name")
def _(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS name", "o_orderkey AS at", "o_custkey AS nanos")
    names = views.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("wall_stage")).distinct()
    pairs = names.join(names.withColumnRenamed("wall_stage", "cpu_stage"), F.col("wall_stage") != F.col("cpu_stage"))
    plan = pairs.select("wall_stage", "cpu_stage", F.concat_ws("/", "wall_stage", "cpu_stage").alias("label"), F.lit(2).alias("workers"))
    return profile.parallel(profile.stages(o), plan).select("label", "wall", "cpu", F.col("efficiency").cast("decimal(18,4)").alias("efficiency"))


@_add("profile_threads", "WITH t AS (SELECT o_custkey % 16 AS w, epoch(o_orderdate)::BIGINT AS b, CASE WHEN o_orderstatus <> 'P' THEN epoch(o_orderdate)::BIGINT + 1 + o_custkey * 100 END AS e FROM orders), v AS (SELECT b AS t, 1 AS d FROM t UNION ALL SELECT e, -1 FROM t WHERE e IS NOT NULL), n AS (SELECT t, sum(d) AS net FROM v GROUP BY t), r AS (SELECT max(c) AS peak FROM (SELECT sum(net) OVER (ORDER BY t) AS c FROM n)) SELECT count(DISTINCT w) AS started, count(b) AS submitted, count(e) AS completed, max(peak)::BIGINT AS peak, least(100.0, sum(e - b) * 100.0 / ((max(e) - min(b)) * 16))::DECIMAL(18, 4) AS utilisation FROM t, r")
def _(spark, sf_dir):
    begin = "unix_timestamp(CAST(o_orderdate AS timestamp))"
    o = views.read(spark, sf_dir, "orders").selectExpr("o_custkey % 16 AS worker", f"{begin} AS begin", f"CASE WHEN o_orderstatus <> 'P' THEN {begin} + 1 + o_custkey * 100 END AS end")
    return profile.threads(o, 16).select("started", "submitted", "completed", "peak", F.col("utilisation").cast("decimal(18,4)").alias("utilisation"))


# aggregates, set operations, sinks, maintenance
@_add("agg_nodes_by_kind", f"WITH {views.TREE_SQL} SELECT file, kind, count(*) AS n, count(DISTINCT name) AS names FROM nodes GROUP BY file, kind")
def _(spark, sf_dir):
    return views.tree(spark, sf_dir).nodes.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@_add("agg_size_estimate", "SELECT p_brand AS file, sum(n)::BIGINT AS total_nodes, sum(256 * n + 128 * 6 + 32 * 6)::BIGINT AS bytes FROM (SELECT p_brand, 32 + (p_size > 25)::INT + CASE WHEN p_partkey % 2 = 1 THEN 4 ELSE 1 END AS n FROM part) GROUP BY p_brand")
def _(spark, sf_dir):
    return analyses.size_estimate(views.code(spark, sf_dir))


@_add("agg_histogram", "WITH s AS (SELECT event_type, (value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL), l AS (SELECT event_type, list_sort(list(v)) AS a FROM s WHERE k <= 2000 GROUP BY event_type), m AS (SELECT event_type, floor(sum(v) / count(*))::BIGINT AS mean FROM s GROUP BY event_type), d AS (SELECT event_type, sum((v - mean) * (v - mean))::DOUBLE AS q FROM s JOIN m USING (event_type) WHERE k <= 2000 GROUP BY event_type) SELECT s.event_type, count(*) AS n, min(v) AS min, max(v) AS max, floor(sum(v) / count(*))::BIGINT AS mean, any_value(a[floor((len(a) - 1) * 50 / 100 + 0.5)::INT + 1]) AS p50, any_value(a[floor((len(a) - 1) * 95 / 100 + 0.5)::INT + 1]) AS p95, any_value(a[floor((len(a) - 1) * 99 / 100 + 0.5)::INT + 1]) AS p99, any_value(CASE WHEN len(a) < 2 THEN 0 ELSE floor(sqrt(q / len(a)))::BIGINT END) AS stddev FROM s JOIN l USING (event_type) JOIN d USING (event_type) GROUP BY s.event_type")
def _(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"), "ts", "event_id")
    return analyses.histogram(e, ["event_type"], "v", ["ts", "event_id"])


@_add("set_changes", "WITH e AS (SELECT event_type || user_id AS p, event_id, day(ts) <= 15 AS early FROM events), a AS (SELECT p, bit_xor(event_id) AS h FROM e WHERE early GROUP BY p), b AS (SELECT p, bit_xor(event_id) AS h FROM e WHERE NOT early GROUP BY p) SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p = b.p WHERE a.h IS DISTINCT FROM b.h")
def _(spark, sf_dir):
    # every event is in one of the states: those of the month's first half, and the later ones
    e = views.read(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("path"), "event_id", (F.dayofmonth("ts") <= 15).alias("early"))
    state = lambda test: e.where(test).groupBy("path").agg(F.bit_xor("event_id").alias("hash"))
    return incremental.changes(state("early"), state("NOT early"))


@_add("incr_latest", "SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("generation"), F.col("event_id").alias("hash"), "event_type")
    return incremental.latest(e).select("path", "event_type")


@_add("incr_dirty_callers", "WITH RECURSIVE e AS (SELECT o_orderkey AS x, o_custkey AS y FROM orders), r AS (SELECT 7::BIGINT AS fn UNION SELECT e.x FROM r JOIN e ON r.fn = e.y) SELECT fn FROM r")
def _(spark, sf_dir):
    # an order calls its customer; the function of an order's number is the customer of that number as well
    calls = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("caller"), F.col("o_custkey").alias("callee"))
    return incremental.dirty_callers(calls, spark.range(7, 8).select(F.col("id").alias("fn")), spark)


_SEVERE = """
rule "a" { severity: critical message: "x|y" find n: Loop where n.text() == "1-URGENT" }
rule "b" { severity: medium find n: Conditional where n.text() == "1-URGENT" }
rule "c" { severity: info find n: Block where n.text() == "1-URGENT" }
"""


@_add("sink_sarif_levels", f"WITH {views.TREE_SQL} SELECT CASE kind WHEN 'Loop' THEN 'error' WHEN 'Conditional' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM nodes WHERE text = '1-URGENT' GROUP BY 1")
def _(spark, sf_dir):
    out = sinks.to_sarif(run_rules(views.tree(spark, sf_dir), _SEVERE))
    return out.groupBy(F.get_json_object("value", "$.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


_FOUND = f"WITH {views.TREE_SQL}, f AS (SELECT file, line, id, CASE kind WHEN 'Loop' THEN 'a' WHEN 'Conditional' THEN 'b' ELSE 'c' END AS rule, CASE kind WHEN 'Loop' THEN 'critical' WHEN 'Conditional' THEN 'medium' ELSE 'info' END AS severity, CASE kind WHEN 'Loop' THEN 'x|y' ELSE '' END AS message, CASE kind WHEN 'Loop' THEN 'error' WHEN 'Conditional' THEN 'warning' ELSE 'note' END AS level FROM nodes WHERE text = '1-URGENT' AND kind IN ('Loop', 'Conditional', 'Block'))"


@_add("sink_sarif_results", _FOUND + " SELECT rule, level, message, file AS uri, line::VARCHAR AS start_line, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf_dir):
    out = sinks.to_sarif(run_rules(views.tree(spark, sf_dir), _SEVERE))
    place = "$.locations[0].physicalLocation"
    paths = {"rule": "$.ruleId", "level": "$.level", "message": "$.message.text", "uri": f"{place}.artifactLocation.uri", "start_line": f"{place}.region.startLine"}
    return out.groupBy(*[F.get_json_object("value", path).alias(name) for name, path in paths.items()]).agg(F.count(F.lit(1)).alias("n"))


@_add("sink_json", _FOUND + " SELECT rule AS rule_id, severity, message, file, id AS node FROM f")
def _(spark, sf_dir):
    out = sinks.to_json(run_rules(views.tree(spark, sf_dir), _SEVERE))
    fields = [F.get_json_object("value", f"$.{c}").alias(c) for c in ("rule_id", "severity", "message", "file")]
    return out.select(*fields, F.get_json_object("value", "$.matched_nodes[0]").cast("long").alias("node"))


@_add("sink_markdown", _FOUND + " SELECT file, count(*) AS n, '## ' || file || chr(10) || chr(10) || '| Line | Severity | Rule | Message |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || line || ' | ' || severity || ' | ' || rule || ' | ' || replace(message, '|', chr(92) || '|') || ' |', chr(10) ORDER BY line, rule) AS value FROM f GROUP BY file")
def _(spark, sf_dir):
    return sinks.to_markdown(run_rules(views.tree(spark, sf_dir), _SEVERE)).select("file", "n", "value")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
