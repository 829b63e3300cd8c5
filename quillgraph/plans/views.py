"""Property graphs over the driver's relational tables, defined alike for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.closure import durable
from quillgraph.plans.graph import Graph

LINE_ORDER = "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
KINDS = {"P": "Conditional", "O": "Loop", "F": "Block"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = 5000) -> DataFrame:
    """``df`` dealt by a key to tasks of about so many rows, for tables whose rows become many: a file of a few MB
    is one task else, however many rows it stands for.  Rows are counted in the files' footers."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def tree(spark: SparkSession, sf_dir: str, children: bool = False, written: bool = False) -> Graph:
    """region > nation > customer > order > line as File > Namespace > MethodDef > Conditional, Loop or
    Block > Call; one file a region, a customer's subtree is one function."""
    t = lambda name: read(spark, sf_dir, name)
    long = lambda c: F.expr(c).cast("long")
    # region and nation are tables of fixed size
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    file = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    lang = F.when(F.col("n_regionkey") % 2 == 0, "c").otherwise("java")
    customer = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    customer = customer.select("c_custkey", "c_name", "n_nationkey", file.alias("file"), lang.alias("lang"))
    order = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    order = order.join(customer.select("c_custkey", "file", "lang"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    line = t("lineitem").withColumn("k", rank).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "k")
    line = line.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    line = line.join(order.select("o_orderkey", "o_custkey", "file", "lang"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.lit(None).cast("string")

    def rows(df, id_, kind, name, text, parent, function, at, args=None):
        return df.select(
            "file", "lang", long(id_).alias("id"), kind.alias("kind"), F.lower(kind).alias("node_type"), name.alias("name"),
            text.alias("text"), long(parent).alias("parent_id"), long(function).alias("function_id"), long(at).alias("line"),
            long(args or "NULL").alias("argument_count"),
        )

    region = t("region").withColumn("n_regionkey", F.col("r_regionkey")).withColumns({"file": file, "lang": lang})
    status = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    nodes = rows(region, "r_regionkey * 8", F.lit("File"), F.col("r_name"), none, "NULL", "NULL", "1")
    nation = nation.withColumns({"file": file, "lang": lang})
    for part in (
        rows(nation, "n_nationkey * 8 + 1", F.lit("Namespace"), F.col("n_name"), none, "n_regionkey * 8", "NULL", "1"),
        rows(customer, "c_custkey * 8 + 2", F.lit("MethodDef"), F.col("c_name"), none, "n_nationkey * 8 + 1", "c_custkey * 8 + 2", "1"),
        rows(order, "o_orderkey * 8 + 3", F.element_at(status, F.col("o_orderstatus")), none, F.col("o_orderpriority"), "o_custkey * 8 + 2", "o_custkey * 8 + 2", "1"),
        rows(line, "(l_orderkey * 1000 + k) * 8 + 4", F.lit("Call"), F.col("p_name"), F.col("l_returnflag"), "l_orderkey * 8 + 3", "o_custkey * 8 + 2", "k", "l_linenumber"),
    ):
        nodes = nodes.unionByName(part)
    if children:
        lists = nodes.groupBy("file", "parent_id").agg(F.array_sort(F.collect_list("id")).alias("children"))
        lists = lists.where("parent_id IS NOT NULL").withColumnRenamed("parent_id", "id")
        nodes = nodes.join(lists, ["file", "id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))
    graph = Graph(spark, {"nodes": nodes})
    return graph.written() if written else graph


TREE_SQL = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + ", ".join(LINE_ORDER) + """) AS k FROM lineitem),
nodes AS MATERIALIZED (
  SELECT 'r' || r_regionkey AS file, r_regionkey::BIGINT * 8 AS id, 'File' AS kind, r_name AS name, NULL::VARCHAR AS text,
         NULL::BIGINT AS parent_id, NULL::BIGINT AS function_id, 1::BIGINT AS line, NULL::BIGINT AS argument_count FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_nationkey::BIGINT * 8 + 1, 'Namespace', n_name, NULL, n_regionkey::BIGINT * 8, NULL, 1, NULL FROM nation
  UNION ALL SELECT 'r' || n_regionkey, c_custkey * 8 + 2, 'MethodDef', c_name, NULL, n_nationkey::BIGINT * 8 + 1, c_custkey * 8 + 2, 1, NULL
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'r' || n_regionkey, o_orderkey * 8 + 3,
         CASE o_orderstatus WHEN 'P' THEN 'Conditional' WHEN 'O' THEN 'Loop' WHEN 'F' THEN 'Block' END, NULL, o_orderpriority,
         o_custkey * 8 + 2, o_custkey * 8 + 2, 1, NULL
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'r' || n_regionkey, (l_orderkey * 1000 + k) * 8 + 4, 'Call', p_name, l_returnflag, l_orderkey * 8 + 3,
         o_custkey * 8 + 2, k, l_linenumber::BIGINT
    FROM li JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey)"""


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Control flow: a user's whole history is a function; event types are blocks numbered by first
    occurrence, consecutive types are edges, those into ``error`` exceptional."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts").withColumn("k", F.row_number().over(order))
    e = e.withColumns({"file": F.lit("events"), "function": F.col("user_id"), "next": F.lead("event_type").over(order)})
    first = e.groupBy("file", "function", "event_type").agg(F.min("k").alias("at"))
    ranks = Window.partitionBy("file", "function").orderBy("at")
    blocks = first.select("file", "function", F.col("event_type").alias("block_key"), (F.row_number().over(ranks) - 1).cast("long").alias("block_ord"))
    number = lambda key, out: blocks.select("file", "function", F.col("block_key").alias(key), F.col("block_ord").alias(out))
    edges = e.where("next IS NOT NULL").select("file", "function", F.col("event_type").alias("a"), F.col("next").alias("b")).distinct()
    edges = edges.join(number("a", "src"), ["file", "function", "a"]).join(number("b", "dst"), ["file", "function", "b"])
    edges = edges.select("file", "function", "src", "dst", F.when(F.col("b") == "error", "exception").otherwise("normal").alias("kind"))
    placed = e.join(number("event_type", "block_ord"), ["file", "function", "event_type"])
    nodes = e.select(
        "file", F.lit("c").alias("lang"), F.col("event_id").alias("id"), F.lit("Call").alias("kind"), F.lit("call").alias("node_type"),
        F.col("event_type").alias("name"), F.col("function").alias("function_id"), F.col("k").cast("long").alias("line"),
    )
    block_nodes = placed.select("file", "function", "block_ord", F.col("event_id").alias("node_id"))
    return Graph(spark, {"nodes": nodes, "blocks": blocks, "cfg_edges": edges, "block_nodes": block_nodes})


FLOW_SQL = """
e AS (SELECT * FROM (SELECT event_id, user_id AS fn, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                            lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)),
blocks AS (SELECT fn, t, row_number() OVER (PARTITION BY fn ORDER BY min(k)) - 1 AS o FROM e GROUP BY fn, t),
alledges AS (SELECT DISTINCT a.fn, a.o AS src, b.o AS dst, b.t = 'error' AS exc FROM e JOIN blocks a ON e.fn = a.fn AND e.t = a.t
          JOIN blocks b ON e.fn = b.fn AND e.nx = b.t),
edges AS (SELECT fn, src, dst FROM alledges WHERE NOT exc),
reach AS (SELECT fn, o AS a, o AS b FROM blocks UNION SELECT r.fn, r.a, x.dst FROM reach r JOIN edges x ON r.fn = x.fn AND r.b = x.src),
live AS (SELECT fn, b FROM reach WHERE a = 0),
avoid AS (SELECT b.fn, b.o AS w, 0::BIGINT AS n FROM blocks b WHERE b.o <> 0
          UNION SELECT v.fn, v.w, x.dst FROM avoid v JOIN edges x ON v.fn = x.fn AND v.n = x.src WHERE x.dst <> v.w),
dom AS (SELECT fn, o AS a, o AS b FROM blocks UNION
        SELECT l.fn, p.o, l.b FROM live l JOIN blocks p ON l.fn = p.fn
        WHERE EXISTS (SELECT 1 FROM live x WHERE x.fn = p.fn AND x.b = p.o)
          AND (p.o = 0 OR NOT EXISTS (SELECT 1 FROM avoid v WHERE v.fn = p.fn AND v.w = p.o AND v.n = l.b)))"""

#: Ids of suppliers, parts, orders and customers in the data-flow graph.
DATA_SQL = """
d AS (SELECT l_suppkey * 8 + 5 AS s, l_partkey * 8 + 6 AS p, l_orderkey * 8 + 3 AS o, o_custkey * 8 + 2 AS c, l_returnflag AS v
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT DISTINCT s AS src, p AS dst, v FROM d UNION SELECT p, o, v FROM d UNION SELECT o, c, v FROM d)"""


def data(spark: SparkSession, sf_dir: str) -> Graph:
    """Data flow: supplier to part to order to customer through every line; the variable is the line's flag."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    line = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.select(
        (F.col("l_suppkey") * 8 + 5).alias("s"), (F.col("l_partkey") * 8 + 6).alias("p"), (F.col("l_orderkey") * 8 + 3).alias("o"),
        (F.col("o_custkey") * 8 + 2).alias("c"), F.col("l_returnflag").alias("v"),
    )
    pairs = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ("sp", "po", "oc")]))
    edges = line.select("v", pairs.alias("e")).select(F.lit("d").alias("file"), "e.src", "e.dst", F.col("v").alias("variable")).distinct()
    edges = edges.withColumn("edge_type", F.when(F.col("variable") == "R", "POINTS_TO").otherwise("REACHING_DEF"))

    def rows(name, id_, kind, label, text, line_="1"):
        return read(spark, sf_dir, name).select(
            F.lit("d").alias("file"), F.lit("c").alias("lang"), F.expr(id_).cast("long").alias("id"), F.lit(kind).alias("kind"),
            F.lower(F.lit(kind)).alias("node_type"), F.expr(label).alias("name"), F.expr(text).cast("string").alias("text"),
            F.expr(line_).cast("long").alias("line"),
        )

    nodes = rows("supplier", "s_suppkey * 8 + 5", "Call", "s_name", "CASE WHEN s_acctbal < 0 THEN 'debt' END")
    for part in (
        rows("part", "p_partkey * 8 + 6", "Assign", "p_brand", "p_type", "p_size"),
        rows("orders", "o_orderkey * 8 + 3", "LocalDef", "o_orderpriority", "o_orderstatus"),
        rows("customer", "c_custkey * 8 + 2", "Return", "c_mktsegment", "c_name"),
    ):
        nodes = nodes.unionByName(part)
    return Graph(spark, {"nodes": nodes, "dfg_edges": edges})


def library(spark: SparkSession, sf_dir: str) -> Graph:
    """A library file with a function a nation, which returns its parameter in every other region; and files of
    callers with a customer's chain input > (the nation's function) > sink each."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name", "n_regionkey")
    # nation is a table of fixed size
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")).join(F.broadcast(nation), "k")
    customer = customer.withColumns({"file": F.concat(F.lit("app"), (F.col("c_custkey") % 64).cast("string")), "c": F.col("c_custkey") * 8})
    none, no_args = F.lit(None).cast("string"), F.array().cast("array<bigint>")

    def rows(df, file, id_, kind, name, function, children=no_args):
        return df.select(file.alias("file"), id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), function.cast("long").alias("function_id"), children.alias("children"))

    lib, fn, k, c, app = F.lit("lib"), F.col("k") * 8 + 1, F.col("k") * 8, F.col("c"), F.col("file")
    nodes = rows(nation, lib, fn, "MethodDef", F.col("n_name"), fn)
    for part in (
        rows(nation, lib, k + 2, "ParamDef", F.lit("x"), fn),
        rows(nation, lib, k + 3, "Return", none, fn),
        rows(customer, app, c + 4, "Call", F.lit("input"), F.lit(None)),
        rows(customer, app, c + 5, "Call", F.col("n_name"), F.lit(None), F.array(c + 4)),
        rows(customer, app, c + 6, "Call", F.lit("sink"), F.lit(None), F.array(c + 5)),
    ):
        nodes = nodes.unionByName(part)
    edge = lambda df, file, a, b: df.select(file.alias("file"), a.alias("src"), b.alias("dst"))
    edges = edge(nation.where("n_regionkey % 2 = 0"), lib, k + 2, k + 3).unionByName(edge(customer, app, c + 5, c + 6))
    xcalls = customer.select("file", (c + 5).alias("call_node"), F.col("n_name").alias("callee_name"))
    return Graph(spark, {"nodes": nodes, "dfg_edges": edges, "xcalls": xcalls})



def _constant(value, type_: str) -> str:
    """SQL of a text, a number, a list of them or None."""
    if isinstance(value, (list, tuple)):
        return f"CAST(array({', '.join(repr(x) for x in value)}) AS {type_})"
    return f"CAST({'NULL' if value is None else repr(value)} AS {type_})"


_WRITTEN: dict[tuple[str, str], Graph] = {}


def code(spark: SparkSession, sf_dir: str) -> Graph:
    """``source`` over parts that are dealt out and written once an application, as are the facts that rules ask of it.
    Its tables are not: making the few columns that a step reads costs less than writing all of them once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        _WRITTEN.clear()
        _WRITTEN[key] = source(spark, sf_dir, written=True)
    return _WRITTEN[key]


def source(spark: SparkSession, sf_dir: str, written: bool = False) -> Graph:
    """Source-like functions, one a part of number k and size z, in one file a brand:

    name(a[, b]) { buf[z]; if (z < 25) { malloc(z) } while (!flag) { buf; a } if (a != 0 | a == 0) { use(a) }
    if (len(a) + 1 < z | a > z) { use(a) } calloc(z, 4) }

    b is there from size 26 on, flag is true from size 41 on; of alternatives odd k have the first.  Node i of part k
    has the id 64 * k + i; ids, kinds and children are listed below.  Data flows from a to its uses (variable a), from
    malloc to buf (POINTS_TO in odd k, else REACHING_DEF).  Blocks: entry 0 (condition z < 25) to then 1 or else 2, both
    to loop 3 (condition !flag), to body 4 or end 5, body back to 3, an exception from 1 to 5."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").alias("z"))
    p = spread(p, "p_partkey")
    p = durable(spark, p, "parts") if written else p
    i = lambda n: F.col("p_partkey") * 64 + n
    big, high, odd = F.col("z") > 25, F.col("z") > 40, F.col("p_partkey") % 2 == 1
    text = lambda c: c.cast("string")
    numbers = lambda *ns: F.array(*[F.lit(n) for n in ns]).cast("array<bigint>")

    def node(n, kind, parent, children=(), fields=(), **more):
        return {"n": n, "kind": kind, "parent_id": parent, "node_type": kind.lower(), "children": children, "field_names": fields} | more

    names = "id kind parent_id function_id node_type children field_names name text operator lit_kind array_size argument_count namespace class_context visibility signature qualified_name base_classes is_constructor is_destructor is_virtual".split()
    types = {"n": "bigint", "array_size": "bigint", "argument_count": "bigint", "base_classes": "array<string>", "id": "bigint", "parent_id": "bigint", "function_id": "bigint", "children": "array<bigint>", "field_names": "array<string>"} | dict.fromkeys(("is_constructor", "is_destructor", "is_virtual"), "boolean")
    top = (2, 5, 6, 13, 20, 30, 40)
    rows = [
        node(1, "MethodDef", None, top, name=F.col("p_name"), namespace=F.col("p_brand"), class_context=F.col("p_type"), visibility=F.when(big, "public").otherwise("private"),
             signature=F.col("p_type"), qualified_name=F.concat_ws(".", "p_brand", "p_name"), base_classes=F.array("p_type", "p_brand"), is_constructor=F.col("z") == 1, is_destructor=F.when(F.col("z") == 2, True), is_virtual=high),
        node(2, "Node", 1, (3, 4), node_type="parameter_list"),
        node(3, "ParamDef", 2, name="a"), node(4, "ParamDef", 2, name="b"),
        node(5, "LocalDef", 1, name="buf", array_size=F.col("z").cast("bigint")),
        node(6, "Conditional", 1, (7, 10), ("condition", "consequence")),
        node(7, "BinaryOp", 6, (8, 9), operator="<"), node(8, "Literal", 7, lit_kind="Int", text=text(F.col("z"))), node(9, "Literal", 7, lit_kind="Int", text="25"),
        node(10, "Block", 6, (11,)), node(11, "Call", 10, (12,), name="malloc", argument_count=1), node(12, "Literal", 11, lit_kind="Int", text=text(F.col("z"))),
        node(13, "Loop", 1, (14, 16, 17), ("condition", "body")), node(14, "UnaryOp", 13, (15,), operator="!"), node(15, "Literal", 14, lit_kind="Bool", text=F.when(high, "true").otherwise("false")),
        node(16, "Identifier", 13, text="buf"), node(17, "Identifier", 13, text="a"),
        node(20, "Conditional", 1, (21, 24), ("condition", "consequence")), node(21, "BinaryOp", 20, (22, 23), operator=F.when(odd, "!=").otherwise("==")),
        node(22, "Identifier", 21, text="a"), node(23, "Literal", 21, lit_kind="Int", text="0"), node(24, "Block", 20, (25,)), node(25, "Call", 24, (26,), name="use", argument_count=1), node(26, "Identifier", 25, text="a"),
        node(30, "Conditional", 1, (31, 38), ("condition", "consequence")), node(31, "BinaryOp", 30, (32, 37), operator=F.when(odd, "<").otherwise(">")),
        node(32, "BinaryOp", 31, (33, 35), operator="+"), node(33, "Call", 32, (34,), name="strlen", argument_count=1), node(34, "Identifier", 33, text="a"), node(35, "Literal", 32, lit_kind="Int", text="1"),
        node(36, "Identifier", 31, text="a"), node(37, "Literal", 31, lit_kind="Int", text=text(F.col("z"))), node(38, "Block", 30, (39,)), node(39, "Call", 38, (43,), name="use", argument_count=1), node(43, "Identifier", 39, text="a"),
        node(40, "Call", 1, (41, 42), name="calloc", argument_count=2), node(41, "Literal", 40, lit_kind="Int", text=text(F.col("z"))), node(42, "Literal", 40, lit_kind="Int", text="4"),
    ]
    there = {4: big, 32: odd, 33: odd, 34: odd, 35: odd, 36: ~odd}
    # what depends on the part is not held in the nodes that are dealt out, which are one constant
    own = {c: {} for c in names}
    own["children"] = {2: F.when(big, numbers(3, 4)).otherwise(numbers(3)), 31: F.when(odd, numbers(32, 37)).otherwise(numbers(36, 37))}
    cells = []
    for r in rows:
        fixed = {c: x for c, x in r.items() if not isinstance(x, Column)}
        for c in r.keys() - fixed.keys():
            own[c][r["n"]] = r[c].cast(types.get(c, "string"))
        held = [f"'{c}', {_constant(fixed.get(c), types.get(c, 'string'))}" for c in ("n", *names)]
        cells.append(f"named_struct({', '.join(held)})")
    one = p.select("*", F.expr(f"explode(array({', '.join(cells)}))").alias("x"))
    for n, test in there.items():
        one = one.where((F.col("x.n") != n) | test)

    def cell(c):
        out = F.col(f"x.{c}")
        for n, value in own[c].items():
            out = F.when(F.col("x.n") == n, value).otherwise(out)
        if c in ("id", "function_id"):
            return i(F.col("x.n") if c == "id" else 1).alias(c)
        if c == "parent_id":
            return i(out).alias(c)
        if c == "children":
            first = F.col("p_partkey") * 64
            return F.when(F.size(out) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(out, lambda x: first + x)).alias(c)
        return out.alias(c)

    nodes = one.select(F.col("p_brand").alias("file"), F.lit("c").alias("lang"), i(F.col("x.n")).alias("line"), *[cell(c) for c in names])
    edge = lambda a, b, v, t="REACHING_DEF": F.struct(i(a).alias("src"), i(b).alias("dst"), F.lit(v).alias("variable"), (F.lit(t) if isinstance(t, str) else t).alias("edge_type"))
    flows = [edge(3, n, "a") for n in (17, 22, 26, 43)] + [F.when(odd, edge(3, 34, "a")), F.when(~odd, edge(3, 36, "a"))]
    flows.append(edge(11, 5, "buf", F.when(odd, "POINTS_TO").otherwise("REACHING_DEF")))
    edges = p.select(F.col("p_brand").alias("file"), F.explode(F.array_compact(F.array(*flows))).alias("e")).select("file", "e.*")
    sites = p.select(
        F.col("p_brand").alias("file"), i(1).alias("caller_fn"), i(11).alias("call_id"), F.lit("malloc").alias("callee"),
        F.when(big, i(1)).alias("callee_id"), F.when(big, "std::malloc").alias("qualified_callee"), F.lit("library").alias("callee_kind"),
    )
    at = lambda *pairs: F.explode(F.array(*[F.struct(*[F.lit(x).cast("long" if not isinstance(x, str) else "string").alias(c) for c, x in zip("xyzw", q, strict=False)]) for q in pairs])).alias("r")
    base = [F.col("p_brand").alias("file"), i(1).alias("function")]
    blocks = p.select(*base, at(*[(n,) for n in range(6)])).select("file", "function", F.col("r.x").alias("block_ord"), F.col("r.x").cast("string").alias("block_key"))
    arms = ((0, 1, 0, "normal"), (0, 2, 1, "normal"), (1, 3, 0, "normal"), (2, 3, 0, "normal"), (3, 4, 0, "normal"), (3, 5, 1, "normal"), (4, 3, 0, "normal"), (1, 5, 0, "exception"))
    arcs = p.select(*base, at(*arms)).select("file", "function", F.col("r.x").alias("src"), F.col("r.y").alias("dst"), F.col("r.z").alias("arm"), F.col("r.w").alias("kind"))
    spots = ((0, 3), (0, 7), (1, 11), (2, 22), (3, 14), (4, 16), (5, 40))
    places = p.select(*base, "p_partkey", at(*spots)).select("file", "function", F.col("r.x").alias("block_ord"), (F.col("p_partkey") * 64 + F.col("r.y")).alias("node_id"))
    meta = p.select(F.col("p_brand").alias("file"), i(1).alias("id"), "z", "p_name", "p_type")
    side = {
        "meta_cpp": meta.select("file", "id", (F.col("z") > 25).alias("is_virtual"), F.array("p_type", "p_name").alias("base_classes")),
        "meta_go": meta.select("file", "id", F.when(F.col("z") > 25, True).alias("is_exported"), F.col("p_name").alias("package_name")),
        "meta_python": meta.select("file", "id", F.array("p_name").alias("decorators"), (F.col("z") < 5).alias("is_async")),
        "meta_java": meta.where("z > 30").select("file", "id", F.lit(True).alias("is_final"), F.array().cast("array<string>").alias("annotations")),
        "meta_js": meta.select("file", "id", F.col("p_type").alias("module_kind"), (F.col("z") == 7).alias("is_arrow")),
        "meta_ts": meta.select("file", "id", F.col("p_type").alias("access_modifier"), (F.col("z") == 8).alias("enum_is_const")),
        "meta_rust": meta.select("file", "id", (F.col("z") < 9).alias("is_unsafe"), F.array("p_type").alias("lifetimes")),
    }
    return Graph(spark, {"nodes": nodes, "dfg_edges": edges, "call_sites": sites, "blocks": blocks, "cfg_edges": arcs, "block_nodes": places, **side})


#: (node, kind, name, text, class, parent, children, there) of each part's program; f is the part's function, g the next one
#: of its file.
_PROGRAM = (
    (1, "MethodDef", "f", "NULL", "c", "NULL", (2, 3, 5, 10, 15, 20, 23, 30, 40, 42), "true"),
    (2, "ParamDef", "'x'", "NULL", "NULL", "1", (), "true"),
    (3, "Call", "g", "NULL", "NULL", "1", (4,), "true"),
    (4, "Identifier", "NULL", "'x'", "NULL", "3", (), "true"),
    (5, "Return", "NULL", "NULL", "NULL", "1", (6,), "true"),
    (6, "Identifier", "NULL", "'x'", "NULL", "5", (), "true"),
    (10, "LocalDef", "'tab' || k", "NULL", "NULL", "1", (11,), "true"),
    (11, "CollectionExpr", "NULL", "NULL", "NULL", "10", (12, 13), "true"),
    (12, "Identifier", "NULL", "f", "NULL", "11", (), "true"),
    (13, "UnaryOp", "NULL", "NULL", "NULL", "11", (14,), "true"),
    (14, "Identifier", "NULL", "g", "NULL", "13", (), "true"),
    (15, "Call", "NULL", "NULL", "NULL", "1", (16,), "true"),
    (16, "Subscript", "NULL", "NULL", "NULL", "15", (17,), "true"),
    (17, "Identifier", "NULL", "'tab' || k", "NULL", "16", (), "true"),
    (20, "Assign", "NULL", "NULL", "NULL", "1", (21, 22), "true"),
    (21, "MemberAccess", "NULL", "'ops.h' || k", "NULL", "20", (), "true"),
    (22, "Identifier", "NULL", "f", "NULL", "20", (), "true"),
    (23, "Call", "NULL", "NULL", "NULL", "1", (24,), "true"),
    (24, "MemberAccess", "NULL", "'ops->h' || k", "NULL", "23", (), "true"),
    (30, "NewExpr", "c", "NULL", "NULL", "1", (), "true"),
    (31, "MethodDef", "c", "NULL", "c", "NULL", (), "k % 2 = 1"),
    (32, "MethodDef", "'run'", "NULL", "c", "NULL", (), "k % 3 = 0"),
    (40, "SendStmt", "NULL", "NULL", "NULL", "1", (41,), "true"),
    (41, "Identifier", "NULL", "'ch' || (k % 640)", "NULL", "40", (), "true"),
    (42, "ReceiveExpr", "NULL", "NULL", "NULL", "1", (43,), "true"),
    (43, "Identifier", "NULL", "'ch' || (k % 640)", "NULL", "42", (), "true"),
)


def program(spark: SparkSession, sf_dir: str) -> Graph:
    """Programs with every way to call a function: a part k is function f<k> of class C<k> in file p<k % 64>, which calls
    the file's next function, by name, through an array and through a field, and makes a C<k>; classes form a binary
    tree in their file.  In odd k the parameter flows to the return and the class has a constructor; run is a method of every
    third class."""
    p = spread(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k")
    p = p.selectExpr("k", "'p' || (k % 64) AS file", "'f' || k AS f", "'f' || (k + 64) AS g", "'C' || k AS c")
    cells = []
    for n, kind, name, text, cls, parent, below, there in _PROGRAM:
        ids = ", ".join(f"k * 64 + {x}" for x in below)
        own = n if kind == "MethodDef" else 1
        up = "CAST(NULL AS bigint)" if parent == "NULL" else f"CAST(k * 64 + {parent} AS bigint)"
        cells.append(f"""IF({there}, named_struct('id', CAST(k * 64 + {n} AS bigint), 'kind', '{kind}', 'name', CAST({name} AS string),
            'text', CAST({text} AS string), 'class_context', CAST({cls} AS string), 'parent_id', {up},
            'function_id', CAST(k * 64 + {own} AS bigint), 'line', CAST({n} AS bigint), 'children', CAST(array({ids}) AS array<bigint>)), NULL)""")
    nodes = p.selectExpr("file", f"explode(array_compact(array({', '.join(cells)}))) AS n").select("file", "n.*")
    nodes = nodes.withColumns({"lang": F.lit("cpp"), "node_type": F.lower("kind")})
    edges = p.where("k % 2 = 1").selectExpr("file", "k * 64 + 2 AS src", "k * 64 + 6 AS dst", "'x' AS variable", "'REACHING_DEF' AS edge_type")
    parents = p.where("k >= 64").selectExpr("file", "c AS child", "'C' || (k % 64 + 64 * (k div 64 div 2)) AS parent")
    return Graph(spark, {"nodes": nodes, "dfg_edges": edges, "supertypes": parents})
