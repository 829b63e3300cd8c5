"""Scans of sources beside the graph: comments, macros, allocators, string literals, global changes and edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.graph import Graph

#: Node types (fixed values): comments, attributes of definitions, and what changes the data flow of a whole program.
COMMENTS = ["comment", "line_comment", "block_comment"]
ATTRIBUTES = ["attribute_specifier", "attribute", "attribute_declaration", "gnu_asm_qualifier", "type_qualifier"]
GLOBAL = [
    "declaration", "preproc_def", "preproc_function_def", "typedef_declaration", "struct_specifier", "union_specifier",
    "enum_specifier", "namespace_definition", "class_specifier", "template_declaration",
]


def comments(graph: Graph) -> DataFrame:
    """(file, line, text) of every comment."""
    return graph.nodes.where(F.col("node_type").isin(COMMENTS)).select("file", "line", "text")


def macros(lines: DataFrame) -> DataFrame:
    """(file, name, params, body, alias) of (file, text) lines ``#define name[(params)] body``, as a preprocessor lists them.

    alias is the function or name that a macro stands for: the whole body if that is one name, or the name before
    the first bracket of a function-like macro; null for others, for names that begin with __ and for the macro's
    own name.  Lines of another form give nothing."""
    part = lambda i: F.regexp_extract("text", r"^\s*#\s*define\s+([A-Za-z_]\w*)(\(([^)]*)\))?(?:\s+(.*?))?\s*$", i)
    out = lines.where(F.col("text").rlike(r"^\s*#\s*define\s+[A-Za-z_]")).select("file", part(1).alias("name"), part(2).alias("_call"), part(3).alias("_params"), part(4).alias("body"))
    out = out.where("name <> ''")
    like = F.col("_call") != ""
    params = F.when(like & (F.trim("_params") != ""), F.transform(F.split("_params", ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    whole = F.regexp_extract("body", r"^([A-Za-z_]\w*)$", 1)
    called = F.regexp_extract("body", r"^\(*([A-Za-z_]\w*)\s*\(", 1)
    alias = F.when(like, F.when(called != "", called).otherwise(whole)).otherwise(whole)
    good = (alias != "") & (alias != F.col("name")) & ~F.col("name").startswith("__")
    return out.select("file", "name", params.alias("params"), "body", F.when(good, alias).alias("alias"))


def resolve_aliases(names: DataFrame, macros_: DataFrame, depth: int = 8) -> DataFrame:
    """names (file, name, ...) with ``resolved``: the name after following aliases of its file, without regard to
    case, at most ``depth`` times, so that a circle of aliases ends too."""
    table = macros_.where("alias IS NOT NULL").groupBy("file", F.lower("name").alias("_key")).agg(F.min("alias").alias("_to"))
    out = names.withColumn("resolved", F.col("name"))
    for _ in range(depth):
        out = out.withColumn("_key", F.lower("resolved")).join(table, ["file", "_key"], "left")
        out = out.withColumn("resolved", F.coalesce("_to", "resolved")).drop("_key", "_to")
    return out


def allocators(graph: Graph) -> DataFrame:
    """(file, name, size_argument) of functions with an attribute malloc or alloc_size(n): the argument counts from 0;
    -1 where alloc_size is absent or has no single number.  Of several definitions the greatest argument holds."""
    n = graph.nodes
    heads = n.where(F.col("node_type").isin("function_definition", "declaration") & F.col("name").isNotNull()).select("file", F.col("id").alias("parent_id"), "name")
    text = F.lower(F.coalesce("text", F.lit("")))
    signs = n.where(F.col("node_type").isin(ATTRIBUTES) | text.contains("__attribute__")).withColumn("_t", text)
    signs = signs.where("contains(_t, 'malloc') OR contains(_t, 'alloc_size')").select("file", "parent_id", "_t")
    number = F.regexp_extract("_t", r"alloc_size[^(]*\(\s*(-?\d+)\s*\)", 1)
    place = number.try_cast("bigint") - 1
    # greatest skips nulls, so an absent number is asked for first
    size = F.when(place.isNull(), F.lit(-1)).otherwise(F.greatest(place, F.lit(0)))
    return signs.join(heads, ["file", "parent_id"]).groupBy("file", "name").agg(F.max(size).cast("long").alias("size_argument"))


def decode_string(raw: Column) -> Column:
    """The value of a string literal: prefix letters, raw-string marks and quotes go, escapes become characters (an
    unknown one the character itself, a last lone backslash stays).  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]+", ""), r"^#+|#+$", "")
    quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
    bare = F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    pieces = F.regexp_extract_all(bare, F.lit(r"(?s)(\\.|\\|[^\\]+)"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\0", "\0"), ("\\", "\\")) for x in pair])
    value = lambda x: F.when(x.startswith("\\"), F.coalesce(F.try_element_at(known, x), F.substring(x, 2, 2))).otherwise(x)
    return F.array_join(F.transform(pieces, value), "")


def string_values(graph: Graph) -> DataFrame:
    """(file, id, value, string_length): decoded string literals and their length in UTF-8 bytes."""
    out = graph.nodes.where("kind = 'Literal' AND lit_kind = 'String'").select("file", "id", decode_string(F.col("text")).alias("value"))
    return out.withColumn("string_length", F.octet_length("value").cast("long"))


def affects_all(graph: Graph) -> DataFrame:
    """(file, id) of nodes outside of functions whose change makes all data flow of a program anew."""
    return graph.nodes.where(F.col("function_id").isNull() & F.col("node_type").isin(GLOBAL)).select("file", "id")


def light_index(graph: Graph) -> dict[str, DataFrame]:
    """What an index without flows keeps: names of functions, calls and constants."""
    n = graph.nodes
    return {
        "functions": n.where("kind = 'MethodDef'").select("file", "id", "name", "qualified_name"),
        "calls": n.where("kind = 'Call'").select("file", F.col("function_id").alias("caller"), F.col("id").alias("call"), "name"),
        "constants": n.where("kind = 'Literal'").select("file", "id", "lit_kind", "text"),
    }


def _edit(old: bytes | None, new: bytes | None):
    old, new = old or b"", new or b""
    if old == new:
        return None
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    most = min(len(a), len(b))
    other = np.flatnonzero(a[:most] != b[:most])
    start = int(other[0]) if len(other) else most
    most -= start
    other = np.flatnonzero(a[len(a) - most :][::-1] != b[len(b) - most :][::-1])
    tail = int(other[0]) if len(other) else most
    ends = len(old) - tail, len(new) - tail
    kind = "insert" if ends[0] == start else "delete" if ends[1] == start else "replace"
    point = lambda text, at: (text.count(b"\n", 0, at), at - 1 - text.rfind(b"\n", 0, at))
    return (start, *ends, kind, *point(old, start), *point(old, ends[0]), *point(new, ends[1]))


EDIT = """start_byte long, old_end_byte long, new_end_byte long, change string, start_row long, start_column long,
    old_end_row long, old_end_column long, new_end_row long, new_end_column long"""


def _edits(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in EDIT.split(",")]
    rows = [_edit(a, b) or (None,) * len(names) for a, b in zip(old, new, strict=True)]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({n: "object" if n == "change" else "Int64" for n in names})


def compute_edit(old: Column | str, new: Column | str) -> Column:
    """The one edit between two versions (binary; null as empty): all but the longest common start and, of the rest, the
    longest common end.  Places are byte offsets, and rows and byte columns from 0; all null where nothing changed."""
    return F.pandas_udf(_edits, EDIT)(old, new)
