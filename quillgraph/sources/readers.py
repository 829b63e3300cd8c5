"""Sources: source trees on any file system, graphs as JSON, rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.language import RuleSet, parse
from quillgraph.plans.graph import SCHEMAS, Graph

#: Extensions and their languages (fixed values); others count as C.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "py": "python",
    "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust",
}
SKIPPED_FOLDERS = ("target", "node_modules", "vendor")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("c"))


def discover(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """(path, lang, hash, content): files of known extensions; contents are read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    known = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(list(LANGUAGES))
    folders = "|".join([r"\.[^/]+", *SKIPPED_FOLDERS])
    inside = F.regexp_replace(path, f"^.*?{root.rstrip('/').rpartition('/')[2]}/", "/")
    keep = known & ~inside.rlike(f"/({folders})/")
    for x in exclude:
        keep = keep & ~path.contains(x)
    return files.where(keep).select("path", language(path).alias("lang"), F.xxhash64("modificationTime", "length").alias("hash"), "content")


def read_graph(spark: SparkSession, path: str, form: str = "json") -> Graph:
    """One folder a table, JSON lines or Parquet, with explicit schemas."""
    return Graph(spark, {name: spark.read.schema(schema).format(form).load(f"{path}/{name}") for name, schema in SCHEMAS.items()})


def write_graph(graph: Graph, path: str, form: str = "parquet") -> None:
    for name in SCHEMAS:
        graph.table(name).write.mode("overwrite").format(form).save(f"{path}/{name}")


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """All rule texts of a file or folder (not below it), merged in order of path."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("p"), "value").orderBy("p").collect()
    out = RuleSet()
    for r in rows:
        out = out.merge(parse(r["value"]))
    return out
