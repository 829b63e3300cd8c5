"""Call graphs beyond plain names: keys of definitions, dispatch by arrays, fields and classes, constructors, summaries.

All are equi-joins on names.  A name that many calls share meets only as many rows as there are definitions of it;
targets are reduced to one a call, or to the distinct ones, before anything else is joined.  Channels pair all ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.analyses import class_closure
from quillgraph.operators.closure import durable, reach
from quillgraph.plans.graph import Graph


def definition_keys(graph: Graph) -> DataFrame:
    """(file, key, id): every name a function answers to in its file: its own, its qualified one, and its own behind
    its class's or namespace's.  Of several functions the least id holds a key."""
    n = graph.nodes.where("kind = 'MethodDef' AND name IS NOT NULL")
    behind = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("::", c, "name"))
    keys = F.explode(F.array_compact(F.array("name", "qualified_name", behind("class_context"), behind("namespace"))))
    return n.select("file", keys.alias("key"), "id").groupBy("file", "key").agg(F.min("id").alias("id"))


def call_graph(graph: Graph) -> DataFrame:
    """(file, caller, callee_name, call, target): one row a caller and callee name, of its least call; target null for
    what the file does not define."""
    n = graph.nodes.where("kind = 'Call' AND name IS NOT NULL AND function_id IS NOT NULL")
    calls = n.groupBy("file", F.col("function_id").alias("caller"), F.col("name").alias("key")).agg(F.min("id").alias("call"))
    out = calls.join(definition_keys(graph).withColumnRenamed("id", "target"), ["file", "key"], "left")
    return out.select("file", "caller", F.col("key").alias("callee_name"), "call", "target")


def called_by(edges: DataFrame) -> DataFrame:
    """(file, target, callers): the sorted callers of each function of a call graph."""
    return edges.where("target IS NOT NULL").groupBy("file", "target").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def _named_functions(graph: Graph, values: DataFrame) -> DataFrame:
    """(file, id, name) values, themselves or below an address-of, that name functions of their file: (file, id, target)."""
    n = graph.nodes
    inner = n.where("kind = 'Identifier'").select("file", F.col("parent_id").alias("id"), F.coalesce("name", "text").alias("_under"))
    out = values.join(inner, ["file", "id"], "left").withColumn("key", F.when(F.col("kind") == "Identifier", F.coalesce("name", "text")).when(F.col("kind") == "UnaryOp", F.col("_under")))
    keys = definition_keys(graph).withColumnRenamed("id", "target")
    return out.join(keys, ["file", "key"]).select("file", "id", "target").distinct()


def array_dispatch(graph: Graph) -> DataFrame:
    """(file, call, target): a call of an element of an array may call each function in the array's initialiser.

    The array is a declaration with a name and a child that lists functions; the call's callee is a Subscript
    (its first child) of that name."""
    n = graph.nodes
    lists = n.where((F.col("kind") == "CollectionExpr") | F.col("node_type").isin("initializer_list", "array_initializer"))
    arrays = n.where(F.col("kind").isin("LocalDef", "FieldDef") & F.col("name").isNotNull()).select("file", F.col("id").alias("parent_id"), F.col("name").alias("array"))
    held = lists.select("file", F.col("id").alias("list"), "parent_id").join(arrays, ["file", "parent_id"]).select("file", F.col("list").alias("parent_id"), "array")
    members = n.select("file", "id", "kind", "name", "text", "parent_id").join(held, ["file", "parent_id"])
    targets = _named_functions(graph, members.select("file", "id", "kind", "name", "text")).join(members.select("file", "id", "array"), ["file", "id"]).select("file", "array", "target").distinct()
    subscripts = n.where("kind = 'Subscript'").select("file", "id", F.get("children", F.lit(0)).alias("base"))
    bases = n.where("kind = 'Identifier'").select("file", F.col("id").alias("base"), F.coalesce("name", "text").alias("array"))
    calls = n.where("kind = 'Call'").select("file", F.col("id").alias("call"), F.get("children", F.lit(0)).alias("id"))
    return calls.join(subscripts, ["file", "id"]).join(bases, ["file", "base"]).join(targets, ["file", "array"]).select("file", "call", "target").distinct()


def field_dispatch(graph: Graph) -> DataFrame:
    """(file, call, target): a call through a field may call each function that an initialiser pair (field first, value
    last) or an assignment to a member of that name gives it."""
    n = graph.nodes
    last = F.element_at("children", -1)
    pairs = n.where((F.size("children") >= 2) & (F.col("node_type").isin("initializer_pair", "keyed_element", "pair") | (F.col("kind") == "Assign")))
    pairs = pairs.select("file", F.get("children", F.lit(0)).alias("at"), last.alias("id"))
    fields = n.where(F.col("node_type").isin("field_designator", "field_identifier") | (F.col("kind") == "MemberAccess"))
    label = F.regexp_extract(F.coalesce("name", "text"), r"([A-Za-z_]\w*)\s*$", 1)
    fields = fields.select("file", F.col("id").alias("at"), label.alias("field")).where("field <> ''")
    given = pairs.join(fields, ["file", "at"]).select("file", "id", "field")
    values = n.select("file", "id", "kind", "name", "text").join(given.select("file", "id").distinct(), ["file", "id"], "left_semi")
    targets = _named_functions(graph, values).join(given, ["file", "id"]).select("file", "field", "target").distinct()
    calls = n.where("kind = 'Call'").select("file", F.col("id").alias("call"), F.get("children", F.lit(0)).alias("at"))
    return calls.join(fields, ["file", "at"]).join(targets, ["file", "field"]).select("file", "call", "target").distinct()


def constructor_calls(graph: Graph) -> DataFrame:
    """(file, call, callee_name, target): ``new T`` calls T's constructor T::T if that is defined, else what is named T;
    target null if neither is."""
    n = graph.nodes.where("kind = 'NewExpr'")
    types = graph.nodes.where(F.col("kind").isin("TypeRef", "Identifier")).groupBy("file", F.col("parent_id").alias("id")).agg(F.min_by(F.coalesce("name", "text"), "id").alias("_type"))
    named = n.join(types, ["file", "id"], "left").withColumn("type", F.trim(F.element_at(F.split(F.coalesce("name", "_type"), r"\("), 1))).where("type <> ''")
    keys = definition_keys(graph).withColumnRenamed("id", "target")
    full = F.concat_ws("::", "type", F.element_at(F.split("type", "::"), -1))
    out = named.select("file", F.col("id").alias("call"), "type", full.alias("key")).join(keys, ["file", "key"], "left")
    plain = keys.select("file", F.col("key").alias("type"), F.col("target").alias("_plain"))
    out = out.join(plain, ["file", "type"], "left")
    return out.select("file", "call", F.when(F.col("target").isNotNull(), F.col("key")).otherwise(F.col("type")).alias("callee_name"), F.coalesce("target", "_plain").alias("target"))


def class_dispatch(graph: Graph, calls: DataFrame) -> DataFrame:
    """(file, call, target) of (file, call, method, class) calls through a receiver of a class: the method of that class or
    of its nearest ancestor that has it, and every override in the classes below."""
    methods = graph.nodes.where("kind = 'MethodDef' AND class_context IS NOT NULL").select("file", F.col("name").alias("method"), F.col("class_context").alias("owner"), F.col("id").alias("target"))
    above = class_closure(graph)
    own = calls.select("file", "call", "method", F.col("class").alias("owner"), F.lit(0).cast("long").alias("far"))
    up = calls.join(above.select("file", F.col("child").alias("class"), F.col("ancestor").alias("owner"), F.col("hops").cast("long").alias("far")), ["file", "class"])
    first = own.unionByName(up.select(own.columns)).join(methods, ["file", "method", "owner"])
    first = first.groupBy("file", "call").agg(F.min(F.struct("far", "target")).alias("b")).select("file", "call", "b.target")
    down = calls.join(above.select("file", F.col("ancestor").alias("class"), F.col("child").alias("owner")), ["file", "class"])
    return first.unionByName(down.join(methods, ["file", "method", "owner"]).select("file", "call", "target")).distinct()


#: Ends of a channel on either side of a tile of pairs, about; receives that stand beside one send in a row; pairs and ends
#: that a task has, about.
TILE, RUN, PAIRS, ENDS = 4096, 128, 16_000_000, 200_000


def channels(graph: Graph, send: Column | None = None, receive: Column | None = None) -> DataFrame:
    """(file, src, dst, variable): what is sent on a channel reaches every receive from a channel of that name in the file.

    These are all pairs of a channel.  They are made tile by tile, so a channel of any share is dealt to many tasks, which
    hold one tile each, and in runs: a send beside ``RUN`` receives, then the next send beside the same ones.  Columns of
    runs that come back compress to a small part of what pairs in another order take where they are written."""
    n, key, tile = graph.nodes, ["file", "variable"], ["file", "variable", "i", "j"]
    name = n.where("kind = 'Identifier'").groupBy("file", F.col("parent_id").alias("id")).agg(F.min_by(F.coalesce("name", "text"), "id").alias("variable"))
    sends = F.col("kind") == "SendStmt" if send is None else send
    receives = F.col("kind") == "ReceiveExpr" if receive is None else receive
    roles = F.array_compact(F.array(F.when(sends, F.lit(True)), F.when(receives, F.lit(False))))
    ends = n.where(sends | receives).select("file", "id", F.explode(roles).alias("sends"))
    ends = durable(graph.spark, ends.join(name, ["file", "id"]), "ends")
    shares = ends.groupBy(*key).agg(F.count_if("sends").alias("s"), F.count_if(~F.col("sends")).alias("r")).where("s > 0 AND r > 0")
    shares = durable(graph.spark, shares, "shares")
    pairs, rows = shares.agg(F.sum(F.col("s").cast("decimal(20,0)") * F.col("r")), F.sum(F.col("s") + F.col("r"))).first()
    tasks = max(1, -(-int(pairs or 0) // PAIRS), -(-int(rows or 0) // ENDS))
    placed = ends.join(shares, key).withColumns({"i": F.ceil(F.col("s") / TILE), "j": F.ceil(F.col("r") / TILE)})
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).alias(c)
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(c)
    sent = placed.where("sends").select(*key, F.col("id").alias("src"), own("i"), each("j")).repartition(tasks, *tile)
    got = placed.where(~F.col("sends")).select(*key, F.col("id").alias("dst"), each("i"), own("j")).repartition(tasks, *tile)
    got = got.groupBy(*tile).agg(F.array_sort(F.collect_list("dst")).alias("all"))
    starts = F.sequence(F.lit(1), F.size("all"), F.lit(RUN))
    runs = got.select(*tile, F.explode(F.transform(starts, lambda at: F.slice("all", at, RUN))).alias("run"))
    out = runs.hint("merge").join(sent, tile)
    return out.select("file", "src", F.explode("run").alias("dst"), "variable")


def summaries(graph: Graph) -> DataFrame:
    """(file, fn_name, effect, idx): parameters (by place) that flow into a return of their own function, TaintReturn.

    Flows go along the file's data-flow edges inside the function; run it once more on a graph whose ``param_effects``
    it has filled, and returns through calls are found too."""
    from quillgraph.operators.taint import summary_edges

    n = graph.nodes
    params = n.where("kind = 'ParamDef' AND function_id IS NOT NULL").groupBy("file", "function_id").agg(F.array_sort(F.collect_list(F.struct("line", "column", "id"))).alias("p"))
    params = params.select("file", "function_id", F.posexplode("p").alias("idx", "p")).select("file", "function_id", F.col("idx").cast("long").alias("idx"), F.col("p.id").alias("seed"))
    edges = graph.table("dfg_edges").select("file", "src", "dst").unionByName(summary_edges(graph))
    spot = n.select("file", F.col("id").alias("node"), F.col("function_id").alias("_f"))
    hit = reach(graph.spark, params.select("file", "seed"), edges, ["file"])
    # what is returned is the return's node or stands below it
    returned = n.where("kind = 'Return'").select("file", F.col("id").alias("node"))
    below = graph.ancestry.join(returned.withColumnRenamed("node", "anc"), ["file", "anc"]).select("file", F.col("desc").alias("node"))
    out = hit.join(returned.unionByName(below).distinct(), ["file", "node"]).join(spot, ["file", "node"]).join(params, ["file", "seed"]).where("_f = function_id")
    names = n.where("kind = 'MethodDef' AND name IS NOT NULL").select("file", F.col("id").alias("function_id"), F.col("name").alias("fn_name"))
    return out.join(names, ["file", "function_id"]).select("file", "fn_name", F.lit("TaintReturn").alias("effect"), "idx").distinct()
