"""Transitive closures as semi-naive joins: each round joins only what the last one found.

Rounds are written to the shared checkpoint folder, so a plan stays short and a
lost executor costs no earlier round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.groups import by_shape


def durable(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to, and read from, the folder that all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/quillgraph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    # files are compressed, so their size is no measure of what a broadcast would hold
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _doubled(spark: SparkSession, edges: DataFrame, most: int) -> DataFrame:
    """(file, anc, desc, depth) of the edges (file, anc, desc, depth) of a forest, depths added up along each path.
    The edges of a path double each round: paths of up to 2**k edges are joined with themselves, so rounds grow with the
    logarithm of the tree's height."""
    out, reach = durable(spark, edges.withColumn("hops", F.lit(1).cast("long")), "tree"), 1
    while reach < most:
        low = out.select("file", F.col("anc").alias("mid"), "desc", F.col("depth").alias("d1"), F.col("hops").alias("h1")).where(F.col("h1") == reach)
        high = out.select("file", "anc", F.col("desc").alias("mid"), F.col("depth").alias("d2"), F.col("hops").alias("h2"))
        more = low.join(high, ["file", "mid"]).select("file", "anc", "desc", (F.col("d1") + F.col("d2")).alias("depth"), (F.col("h1") + F.col("h2")).alias("hops"))
        more = durable(spark, more.where(F.col("anc") != F.col("desc")), "tree")
        if not more.limit(1).count():
            break
        out, reach = out.unionByName(more), reach * 2
    return out.drop("hops")


def ancestors(spark: SparkSession, tree: DataFrame, most: int = 512) -> DataFrame:
    """(file, anc, desc, depth) of (file, id, parent_id, function_id), up to ``most`` edges deep.

    What stays inside a function is found in one pass over functions.  Nodes whose parent is elsewhere (in another
    function or, as they, in none) are linked by joins: they alone are a tree, whose paths double each round."""
    pairs = ["file", "anc", "desc", "depth"]

    def run(given):
        up, out = {r["id"]: r["parent_id"] for r in given}, []
        for i, p in up.items():
            if p is not None and p not in up:
                out.append((p, i, 0))
            depth = 1
            while p in up and p != i and depth <= most:
                out.append((p, i, depth))
                p, depth = up[p], depth + 1
        return out

    one = tree.where("function_id IS NOT NULL").select("file", "function_id", "id", "parent_id")
    made = by_shape(one, ["file", "function_id"], run, "anc long, desc long, depth long", ["id", "parent_id"], "id", shifted=["anc", "desc"])
    made = durable(spark, made.select(*pairs), "tree")
    inside = made.where("depth > 0")
    free = tree.where("function_id IS NULL AND parent_id IS NOT NULL").select("file", F.col("parent_id").alias("anc"), F.col("id").alias("desc"))
    leaves = durable(spark, made.where("depth = 0").select("file", "anc", "desc").unionByName(free), "leaves")
    if not leaves.limit(1).count():
        return inside
    # (file, desc, top, k): the node at or above each node where its function is left
    tops = leaves.select("file", F.col("desc").alias("top")).join(inside.select("file", F.col("anc").alias("top"), "desc", F.col("depth").alias("k")), ["file", "top"])
    tops = durable(spark, tops.select("file", "desc", "top", "k").unionByName(leaves.select("file", "desc", F.col("desc").alias("top"), F.lit(0).cast("long").alias("k"))), "tops")
    links = leaves.withColumnsRenamed({"desc": "low", "anc": "desc"}).join(tops, ["file", "desc"])
    far = _doubled(spark, links.select("file", F.col("top").alias("anc"), F.col("low").alias("desc"), (F.col("k") + 1).alias("depth")), most)
    far = far.unionByName(leaves.select("file", F.col("desc").alias("anc"), "desc", F.lit(0).cast("long").alias("depth")))
    # the parents of a top and of all tops above it, and what is above these in their functions
    out = leaves.withColumnsRenamed({"anc": "up", "desc": "anc"}).join(far, ["file", "anc"])
    out = out.select("file", F.col("up").alias("anc"), F.col("desc").alias("top"), (F.col("depth") + 1).alias("depth"))
    over = inside.select("file", "anc", F.col("desc").alias("mid"), F.col("depth").alias("d"))
    more = out.withColumnRenamed("anc", "mid").join(over, ["file", "mid"]).select("file", "anc", "top", (F.col("depth") + F.col("d")).alias("depth"))
    out = out.unionByName(more).join(tops, ["file", "top"]).select("file", "anc", "desc", (F.col("depth") + F.col("k")).alias("depth"))
    return inside.unionByName(durable(spark, out.where((F.col("anc") != F.col("desc")) & (F.col("depth") <= most)), "tree"))


def reach(
    spark: SparkSession,
    seeds: DataFrame,
    edges: DataFrame,
    keys: list[str],
    blocked: DataFrame | None = None,
    most: int | None = None,
    via: bool = False,
) -> DataFrame:
    """(keys..., seed, node, hops): nodes reached from each seed, the seed itself at 0 hops.

    seeds: (keys..., seed), with a column ``node`` where a seed starts from other nodes than itself; edges: (keys..., src,
    dst); blocked: (keys..., node) never entered, though a seed may stand on one; most: bound on hops.  hops is the least
    number of edges.  via: with a column ``src``, the least node one hop less away that leads to the node."""
    edges = edges.select(*keys, "src", "dst").where(F.col("src") != F.col("dst")).distinct()
    if blocked is not None:
        edges = edges.join(blocked.select(*keys, F.col("node").alias("dst")).distinct(), [*keys, "dst"], "left_anti")
    edges = durable(spark, edges, "edges")
    start = F.col("node" if "node" in seeds.columns else "seed").alias("node")
    front = seeds.select(*keys, "seed", start).distinct().withColumn("hops", F.lit(0).cast("long"))
    front = front.withColumn("src", F.lit(None).cast("long")) if via else front
    front = durable(spark, front, "front")
    seen, hops = front, 0
    while most is None or hops < most:
        hops += 1
        step = front.select(*keys, "seed", F.col("node").alias("src")).join(edges, [*keys, "src"])
        step = step.withColumnRenamed("dst", "node")
        rows = [*keys, "seed", "node"]
        step = step.groupBy(*rows).agg(F.min("src").alias("src")) if via else step.select(*rows).distinct()
        step = step.join(seen.select(*rows), rows, "left_anti").withColumn("hops", F.lit(hops).cast("long"))
        front = durable(spark, step.select(*front.columns), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def nearest_seed(spark: SparkSession, seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node, seed): each node that some seed reaches, once, with the nearest seed, the least of equally
    near ones.  A round carries one row a node, however many seeds reach it."""
    edges = edges.select(*keys, "src", "dst").where(F.col("src") != F.col("dst")).distinct()
    edges = durable(spark, edges, "edges")
    front = seeds.select(*keys, F.col("seed").alias("node"), "seed").distinct()
    seen = front = durable(spark, front, "front")
    while True:
        step = front.withColumnRenamed("node", "src").join(edges, [*keys, "src"])
        step = step.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("seed").alias("seed"))
        front = durable(spark, step.join(seen, [*keys, "node"], "left_anti"), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
