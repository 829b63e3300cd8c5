"""Control flow and data flow from syntax trees.

Control flow is built a function at a time (one group of (file, function), bounded by the size of a source function; equal
functions once a task).  Statements become points from the last one backwards, so each knows what follows it; straight runs of
points are then blocks.  Data flow joins definitions and uses of a variable in a function where the blocks allow it.

Defined results: a function without statements has an entry and an exit block; kinds that are not listed are plain
statements; blocks are maximal, so what has a single way to it shares its block; code behind a jump is in blocks of its own, which nothing leads to; a jump to an unknown label ends its
path; names and texts may be null.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import cfg
from quillgraph.operators.groups import by_shape
from quillgraph.plans.graph import Graph

#: Functions that never return (fixed values).
NORETURN = ["abort", "exit", "_exit", "_Exit", "quick_exit", "longjmp", "siglongjmp", "pthread_exit", "thrd_exit", "__assert_fail"]
#: Stands between the fields of a node while they are one text.
FIELD_MARK = "\x1f"
#: Kinds whose evaluation may raise.
RAISING = {"Call", "NewExpr", "Throw", "DeleteExpr"}
#: Languages whose cases run on into the next one.
FALLS_THROUGH = {"c", "cpp", "java", "javascript", "typescript"}
#: Fields of a statement that belong to its head.
HEAD = {"condition", "value", "initializer", "init", "left", "right", "update", "increment", "resources", "parameters", "label", "name"}


@dataclass
class Flow:
    """Points of a function: the nodes in each, and what follows it, as (point, arm, kind)."""

    tree: dict
    lang: str
    noreturn: set
    held: list = field(default_factory=list)
    after: list = field(default_factory=list)
    labels: dict = field(default_factory=dict)

    def point(self, nodes=(), *after) -> int:
        self.held.append(list(nodes))
        self.after.append([(p, arm, "normal") for arm, p in enumerate(after)])
        return len(self.held) - 1

    def below(self, *roots) -> list:
        out, todo = [], list(reversed(roots))
        while todo:
            n = todo.pop()
            if n in self.tree:
                out.append(n)
                todo.extend(reversed(self.tree[n]["children"]))
        return out

    def parts(self, n) -> dict:
        """Children of a statement by the name of their field; those without one are under ''."""
        out: dict = {}
        t = self.tree[n]
        fields = list(t["fields"]) + [""] * len(t["children"])
        for c, f in zip(t["children"], fields, strict=False):
            if c in self.tree:
                out.setdefault(f or "", []).append(c)
        return out

    def word(self, n) -> str | None:
        return next((self.tree[c]["text"] or self.tree[c]["name"] for c in self.tree[n]["children"] if c in self.tree and self.tree[c]["kind"] == "Identifier"), None)


@dataclass(frozen=True)
class Around:
    """Where break, continue and exceptions go."""

    end: int
    leave: int | None = None
    again: int | None = None
    pad: int | None = None
    inside: tuple = ()
    label: str | None = None
    case: int | None = None


def _chain(flow: Flow, nodes, to: int, at: Around):
    for n in reversed(nodes):
        to = yield _statement(flow, n, to, at)
    return to


def _test(flow: Flow, n, yes: int, no: int, at: Around):
    """The point where a condition begins; both operands of && and || are tests of their own."""
    t = flow.tree[n]
    inner = [c for c in t["children"] if c in flow.tree]
    if t["kind"] == "BinaryOp" and t["operator"] in ("&&", "||", "and", "or") and len(inner) == 2:
        second = yield _test(flow, inner[1], yes, no, at)
        either = t["operator"] in ("||", "or")
        return (yield _test(flow, inner[0], yes if either else second, second if either else no, at))
    if t["node_type"] in ("parenthesized_expression", "condition_clause") and len(inner) == 1:
        return (yield _test(flow, inner[0], yes, no, at))
    return _raises(flow, flow.point(flow.below(n), yes, no), at)


def _raises(flow: Flow, p: int, at: Around) -> int:
    if at.pad is not None and any(flow.tree[n]["kind"] in RAISING for n in flow.held[p]):
        flow.after[p].append((at.pad, 0, "exception"))
    return p


def _loop(flow: Flow, n, to: int, at: Around):
    parts, t = flow.parts(n), flow.tree[n]
    first = parts.get("initializer", []) + parts.get("init", [])
    step = parts.get("update", []) + parts.get("increment", [])
    body = [c for f, cs in parts.items() if f not in HEAD for c in cs]
    head = flow.point()
    turn = flow.point(flow.below(*step), head) if step else head
    around = replace(at, leave=to, again=turn, inside=(*at.inside, (at.label, to, turn)), label=None, case=None)
    if t["loop_kind"] == "do" or t["node_type"] == "do_statement":
        begin = flow.point()
        test = (yield _test(flow, parts["condition"][0], begin, to, at)) if parts.get("condition") else flow.point((), to)
        flow.after[head] = [(test, 0, "normal")]
        flow.after[begin] = [((yield _chain(flow, body, head, around)), 0, "normal")]
        return flow.point([n], begin)
    begin = yield _chain(flow, body, turn, around)
    if parts.get("condition"):
        test = yield _test(flow, parts["condition"][0], begin, to, at)
        flow.after[head] = [(test, 0, "normal")]
    else:
        # without a test a loop may end (over a range, it does), but for one that says it is endless
        each = parts.get("left", []) + parts.get("right", []) + parts.get("value", [])
        flow.held[head] = flow.below(*each)
        flow.after[head] = [(begin, 0, "normal")]
        if t["loop_kind"] != "loop" and t["node_type"] != "loop_expression":
            flow.after[head].append((to, 1, "normal"))
    return flow.point([n, *flow.below(*first)], head)


def _switch(flow: Flow, n, to: int, at: Around):
    parts = flow.parts(n)
    head = [c for f in ("initializer", "init", "condition", "value") for c in parts.get(f, [])]
    cases = [c for f, cs in parts.items() if f not in HEAD for c in cs]
    while len(cases) == 1 and flow.tree[cases[0]]["kind"] == "Block":
        cases = [c for c in flow.tree[cases[0]]["children"] if c in flow.tree]
    fall, entries = to, []
    runs_on = flow.lang in FALLS_THROUGH and flow.tree[n]["kind"] == "Switch"
    for case in reversed(cases):
        inner = flow.parts(case)
        body = [c for f, cs in inner.items() if f not in HEAD for c in cs]
        around = replace(at, leave=to, inside=(*at.inside, (at.label, to, None)), label=None, case=fall)
        begin = yield _chain(flow, body, fall if runs_on else to, around)
        fall = flow.point([case, *flow.below(*[c for f, cs in inner.items() if f in HEAD for c in cs])], begin)
        entries.append(fall)
    return _raises(flow, flow.point([n, *flow.below(*head)], *reversed(entries), to), at)


def _try(flow: Flow, n, to: int, at: Around):
    inner = [c for c in flow.tree[n]["children"] if c in flow.tree]
    catches = [c for c in inner if flow.tree[c]["kind"] == "Catch"]
    last = [c for c in inner if flow.tree[c]["kind"] == "Finally"]
    body = [c for c in inner if c not in catches and c not in last]
    for c in reversed(last):
        to = yield _chain(flow, flow.tree[c]["children"], to, at)
    pads = []
    for c in catches:
        parts = flow.parts(c)
        begin = yield _chain(flow, [x for f, cs in parts.items() if f not in HEAD for x in cs], to, at)
        pads.append(flow.point([c, *flow.below(*[x for f, cs in parts.items() if f in HEAD for x in cs])], begin))
    # the first clause stands for the whole row of them
    begin = yield _chain(flow, body, to, replace(at, pad=pads[0]) if pads else at)
    p = flow.point([n], begin)
    if pads:
        flow.after[p].append((pads[0], 0, "exception"))
    return p


def _jump(flow: Flow, n, at: Around) -> int:
    kind, word, p = flow.tree[n]["kind"], flow.word(n), flow.point(flow.below(n))
    loops = [x for x in at.inside if kind == "Break" or x[2] is not None]
    if word is not None:
        loops = [x for x in loops if x[0] == word]
    if loops:
        flow.after[p] = [(loops[-1][1 if kind == "Break" else 2], 0, "normal")]
    return p


def _statement(flow: Flow, n, to: int, at: Around):
    """The point where statement n begins, if ``to`` follows it."""
    if n not in flow.tree:
        return to
    t = flow.tree[n]
    kind = t["kind"]
    if kind in ("MethodDef", "ClassDef", "LambdaDef", "ClosureExpr"):
        return flow.point([n], to)
    if kind == "Block" or t["node_type"] in ("compound_statement", "else_clause", "switch_body"):
        return (yield _chain(flow, t["children"], to, at))
    if kind == "Conditional":
        parts = flow.parts(n)
        rest = [c for f, cs in parts.items() if f not in HEAD | {"consequence", "alternative"} for c in cs]
        yes = yield _chain(flow, parts.get("consequence", rest), to, at)
        no = (yield _chain(flow, parts["alternative"], to, at)) if parts.get("alternative") else to
        test = (yield _test(flow, parts["condition"][0], yes, no, at)) if parts.get("condition") else flow.point((), yes, no)
        return flow.point([n, *flow.below(*parts.get("initializer", []), *parts.get("init", []))], test)
    if kind in ("Loop", "LoopExpr"):
        return (yield _loop(flow, n, to, at))
    if kind in ("Switch", "TypeSwitch", "SelectStmt", "MatchExpr", "SwitchExpr"):
        return (yield _switch(flow, n, to, at))
    if kind == "Try":
        return (yield _try(flow, n, to, at))
    if kind == "Label":
        word = flow.word(n)
        inner = [c for c in t["children"] if c in flow.tree and flow.tree[c]["kind"] != "Identifier"]
        begin = yield _chain(flow, inner, to, replace(at, label=word))
        p = flow.labels.get(word, flow.point())
        flow.held[p], flow.after[p] = [n], [(begin, 0, "normal")]
        return p
    if kind in ("Break", "Continue"):
        return _jump(flow, n, at)
    if kind == "Goto":
        return flow.point(flow.below(n), *([flow.labels[flow.word(n)]] if flow.word(n) in flow.labels else []))
    if kind == "Fallthrough":
        return flow.point([n], at.case if at.case is not None else to)
    if kind == "Return":
        return _raises(flow, flow.point(flow.below(n), at.end), at)
    if kind == "Throw":
        return _raises(flow, flow.point(flow.below(n), *([] if at.pad is not None else [at.end])), at)
    parts = flow.parts(n)
    if kind in ("With", "Synchronized") and parts.get("body"):
        begin = yield _chain(flow, parts["body"], to, at)
        return _raises(flow, flow.point([n, *flow.below(*[c for f, cs in parts.items() if f != "body" for c in cs])], begin), at)
    nodes = flow.below(n)
    ends = any(flow.tree[x]["kind"] == "Call" and flow.tree[x]["name"] in flow.noreturn for x in nodes)
    return _raises(flow, flow.point(nodes, *([] if ends else [to])), at)


def _run(step):
    """Runs a recursion written as generators, however deep: its depth is on the heap."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def function_flow(tree: dict, root: int, lang: str = "c", noreturn=NORETURN):
    """(nodes of each block, [(src, dst, arm, kind)]) of a function; block 0 is the entry, the last one the exit.

    tree: id to dict of kind, node_type, name, text, operator, loop_kind, children, fields."""
    flow = Flow(tree, lang, set(noreturn))
    end = flow.point()
    for n in flow.below(root):
        if tree[n]["kind"] == "Label":
            flow.labels.setdefault(flow.word(n), flow.point())
    parts = flow.parts(root)
    body = parts.get("body") or [c for cs in parts.values() for c in cs if tree[c]["kind"] != "ParamDef" and tree[c]["node_type"] not in ("parameter_list", "parameters", "formal_parameters")]
    start = flow.point((), _run(_chain(flow, body, end, Around(end))))

    def settle(p):
        """The first point from p on that holds something or where the way parts."""
        seen = set()
        while p != end and not flow.held[p] and len(flow.after[p]) == 1 and p not in seen:
            seen.add(p)
            p = flow.after[p][0][0]
        return p

    start = settle(start)
    links = {p: list(dict.fromkeys((settle(q), arm, kind) for q, arm, kind in flow.after[p])) for p in range(len(flow.held)) if settle(p) == p and p != end}
    links[end] = []
    order, todo, seen = [], [], set()
    for first in [start, *sorted((p for p in links if flow.held[p]), key=lambda p: min(flow.held[p]))]:
        todo.append(first)
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                order.append(p)
                todo.extend(q for q, _, _ in reversed(links[p]))
    came: dict = {}
    for p in order:
        for q, _, kind in links[p]:
            came.setdefault(q, []).append((p, kind))
    block: dict = {}
    for p in order:
        sole = came.get(p, [])
        joins = p not in (start, end) and len(sole) == 1 and sole[0][1] == "normal" and len([x for x in links[sole[0][0]] if x[2] == "normal"]) == 1 and sole[0][0] in block
        # a point that may raise ends its block
        joins = joins and all(x[2] == "normal" for x in links[sole[0][0]])
        if joins:
            block[p] = block[sole[0][0]]
        elif p != end:
            block[p] = len(set(block.values()))
    block[end] = len(set(block.values()))
    nodes: list = [[] for _ in range(block[end] + 1)]
    for p in order:
        nodes[block[p]].extend(flow.held[p])
    edges = [(block[p], block[q], arm, kind) for p in order for q, arm, kind in links[p] if not (block[p] == block[q] and came[q] == [(p, "normal")] and q != start and len(links[p]) == 1 and p != q)]
    return nodes, list(dict.fromkeys(edges))


def noreturn_names(graph: Graph, extra: list[str] = ()) -> DataFrame:
    """(file, name): functions that never return in a file, by an attribute or token ``noreturn`` of their definition or
    declaration; the built-in ones and ``extra`` hold in every file and are not repeated here."""
    n = graph.nodes
    marked = F.lower(F.col("text")).rlike(r"(^|[^0-9a-z])_?noreturn($|[^0-9a-z_])")
    signs = n.where(F.col("node_type").isin("attribute", "attribute_specifier", "attribute_declaration", "type_qualifier", "_Noreturn") & F.lower(F.col("text")).contains("noreturn"))
    signs = signs.select("file", F.col("parent_id").alias("id")).distinct().withColumn("_signed", F.lit(True))
    heads = n.where((F.col("kind") == "MethodDef") | F.col("node_type").isin("declaration", "function_definition")).join(signs, ["file", "id"], "left")
    bare = F.size(F.coalesce("children", F.array().cast("array<bigint>"))) == 0
    heads = heads.where(F.coalesce("_signed", F.lit(False)) | (bare & F.coalesce(marked, F.lit(False))))
    return heads.where("name IS NOT NULL").select("file", "name").distinct()


def control_flow(graph: Graph, extra: list[str] = ()) -> DataFrame:
    """(file, function, what, a, b, arm, kind): rows of blocks (a), of nodes in blocks (a in b) and of edges (a to b)."""
    n = graph.nodes.where("function_id IS NOT NULL")
    names = noreturn_names(graph).withColumn("_own", F.lit(True))
    cols = ["id", "kind", "node_type", "name", "text", "operator", "loop_kind", "lang", "children"]
    fields = F.array_join("field_names", FIELD_MARK, "").alias("fields")
    rows = n.select("file", F.col("function_id").alias("function"), F.col("function_id").alias("root"), *cols, fields)
    # calls alone are asked, by file and name: a file with many nodes is no group of its own
    called = (F.col("kind") == "Call") & F.col("name").isNotNull()
    rest = rows.where(~F.coalesce(called, F.lit(False))).withColumn("_own", F.lit(None).cast("boolean"))
    rows = rows.where(called).join(names, ["file", "name"], "left").select(rest.columns).unionByName(rest)
    # texts are asked only of identifiers, names also of calls that don't return: these have one name
    ends = (F.col("kind") == "Call") & (F.col("name").isin(*NORETURN, *extra) | F.coalesce("_own", F.lit(False)))
    word = F.col("kind") == "Identifier"
    rows = rows.withColumns({"text": F.when(word, F.col("text")), "name": F.when(ends, F.lit(NORETURN[0])).when(word, F.col("name"))})

    def run(given):
        tree, root = {r["id"]: r for r in given}, given[0]["root"]
        for x in given:
            x["fields"] = (x["fields"] or "").split(FIELD_MARK)
        if root not in tree:
            return []
        nodes, edges = function_flow(tree, root, given[0]["lang"] or "c")
        out = [("block", None, b, None, None, None) for b in range(len(nodes))]
        out += [("node", x, None, b, None, None) for b, held in enumerate(nodes) for x in held]
        return out + [("edge", None, *e) for e in edges]

    words = ["kind", "node_type", "name", "text", "operator", "loop_kind", "lang", "fields"]
    out = by_shape(rows, ["file", "function"], run, "what string, node long, a long, b long, arm long, kind string", ["id", "root"], "id", ["children"], words, ["node"])
    return out.select("file", "function", "what", F.coalesce("node", "a").alias("a"), "b", "arm", "kind")


def with_control_flow(graph: Graph, extra: list[str] = ()) -> Graph:
    """The graph with blocks, block_nodes and cfg_edges built from its nodes; the pass is run and written once."""
    built = graph._once(control_flow(graph, extra), "built")
    kind = lambda k: built.where(F.col("what") == k)
    blocks = kind("block").select("file", "function", F.col("a").cast("string").alias("block_key"), F.col("a").alias("block_ord"))
    placed = kind("node").select("file", "function", F.col("b").alias("block_ord"), F.col("a").alias("node_id"))
    edges = kind("edge").select("file", "function", F.col("a").alias("src"), F.col("b").alias("dst"), "arm", "kind")
    return graph.only(blocks=blocks, block_nodes=placed, cfg_edges=edges)


def definitions(graph: Graph) -> DataFrame:
    """(file, function, variable, node): parameters, locals and assignments (of their first child's name)."""
    n = graph.nodes.where("function_id IS NOT NULL")
    named = n.where(F.col("kind").isin("ParamDef", "LocalDef")).select("file", F.col("function_id").alias("function"), F.col("name").alias("variable"), F.col("id").alias("node"))
    target = n.where("kind = 'Assign'").select("file", F.col("id").alias("node"), F.get("children", F.lit(0)).alias("id"))
    target = target.join(n.where("kind = 'Identifier'").select("file", "id", F.col("function_id").alias("function"), F.coalesce("name", "text").alias("variable")), ["file", "id"])
    return named.unionByName(target.select("file", "function", "variable", "node")).where("variable IS NOT NULL")


def uses(graph: Graph) -> DataFrame:
    """(file, function, variable, node): identifiers that are not the target of an assignment."""
    n = graph.nodes.where("function_id IS NOT NULL")
    target = n.where("kind = 'Assign' AND coalesce(operator, '=') = '='").select("file", F.get("children", F.lit(0)).alias("id"))
    out = n.where("kind = 'Identifier'").join(target, ["file", "id"], "left_anti")
    return out.select("file", F.col("function_id").alias("function"), F.coalesce("name", "text").alias("variable"), F.col("id").alias("node")).where("variable IS NOT NULL")


def data_flow(graph: Graph) -> DataFrame:
    """(file, src, dst, variable, edge_type) from definitions to the uses that control flow, exceptions included, lets
    them reach: REACHING_DEF, or LOOP_CARRY where only a further turn of a loop does.  Where a node has no block, the
    order of the source decides.  Nothing is killed on the way."""
    every = graph.table("cfg_edges").withColumn("kind", F.lit("normal"))
    reach = graph._once(cfg.facts(graph.spark, graph.table("blocks"), every).where("fact = 'reach'").select("file", "function", "a", "b"), "reach")
    around = every.where("src = dst").select("file", "function", F.col("src").alias("a"), F.col("dst").alias("b"))
    around = around.unionByName(every.where("src <> dst").select("file", "function", F.col("src").alias("b"), F.col("dst").alias("a")).join(reach, ["file", "function", "a", "b"]).select("file", "function", F.col("b").alias("a"), "b"))
    ways = reach.where("a <> b").unionByName(around).distinct().withColumn("_way", F.lit(True))
    place = graph.table("block_nodes").select("file", F.col("node_id").alias("node"), "block_ord")
    # only nodes of these kinds define or use
    spot = graph.nodes.where(F.col("kind").isin("ParamDef", "LocalDef", "Assign", "Identifier"))
    spot = spot.select("file", F.col("id").alias("node"), F.struct("line", "column", "id").alias("at"))
    ends = definitions(graph).withColumn("_def", F.lit(True)).unionByName(uses(graph).withColumn("_def", F.lit(False)))
    ends = graph._once(ends.join(spot, ["file", "node"]).join(place, ["file", "node"], "left"), "ends")

    def located(is_def, block, at, node):
        out = ends.where(F.col("_def") == is_def)
        return out.select("file", "function", "variable", F.col("block_ord").alias(block), F.col("at").alias(at), F.col("node").alias(node))

    pairs = located(True, "a", "_from", "src").join(located(False, "b", "_to", "dst"), ["file", "function", "variable"])
    # parameters stand before every block
    entry = F.coalesce("a", F.lit(0))
    pairs = pairs.withColumn("_first", F.col("_from") <= F.col("_to"))
    pairs = pairs.withColumn("a", F.when(F.col("b").isNotNull(), entry)).join(ways, ["file", "function", "a", "b"], "left")
    straight = F.col("_first") & (F.col("_way") | F.col("b").isNull() | (F.col("a") == F.col("b")))
    pairs = pairs.where(F.coalesce(straight, F.lit(False)) | F.col("_way"))
    kind = F.when(F.col("_first"), "REACHING_DEF").otherwise("LOOP_CARRY")
    return pairs.select("file", "src", "dst", "variable", kind.alias("edge_type")).distinct()


def with_flows(graph: Graph, extra: list[str] = ()) -> Graph:
    """The graph with control flow and data flow built from its syntax tree; other data-flow edges stay."""
    graph = with_control_flow(graph, extra)
    fresh = data_flow(graph).withColumn("field_path", F.lit(None).cast("array<string>"))
    return graph.only(dfg_edges=graph.table("dfg_edges").unionByName(fresh.select(graph.table("dfg_edges").columns)).distinct())
