"""Sinks of findings: JSON, SARIF 2.1.0, Markdown and HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(severity: Column) -> Column:
    """SARIF level of a severity."""
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def to_json(findings: DataFrame) -> DataFrame:
    """One JSON text a finding."""
    return findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value"))


def to_sarif(findings: DataFrame) -> DataFrame:
    """One JSON text a result of the SARIF run; ``sarif_report`` frames them."""
    region = F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
    )
    return findings.select(F.to_json(result).alias("value"))


def to_markdown(findings: DataFrame) -> DataFrame:
    """(file, n, value): a table of each file's findings in order of line; vertical bars are escaped."""
    esc = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    span = F.when(F.col("end_line") > F.col("line"), F.concat_ws("-", "line", "end_line")).otherwise(F.col("line").cast("string"))
    row = F.concat(F.lit("| "), F.coalesce(span, F.lit("")), F.lit(" | "), "severity", F.lit(" | "), esc(F.col("rule_id")), F.lit(" | "), esc(F.col("message")), F.lit(" |"))
    rows = findings.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("line", "rule_id", row.alias("row")))).alias("r"))
    head = F.concat(F.lit("## "), F.col("file"), F.lit("\n\n| Line | Severity | Rule | Message |\n| --- | --- | --- | --- |\n"))
    return rows.select("file", "n", F.concat(head, F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("value"))


def sarif_report(findings: DataFrame, tool: str = "quillgraph", most: int = 100_000) -> str:
    """A whole report as text; for more than ``most`` findings write ``to_sarif`` instead."""
    rows = to_sarif(findings).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings; write to_sarif(findings) instead")
    run = {"tool": {"driver": {"name": tool}}, "results": [json.loads(r["value"]) for r in rows]}
    return json.dumps({"version": "2.1.0", "runs": [run]}, indent=2)


def html_report(findings: DataFrame, most: int = 10_000) -> str:
    rows = to_markdown(findings).orderBy("file").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files with findings")
    body = "".join(f"<section><h2>{html.escape(r['file'] or '')} ({r['n']})</h2><pre>{html.escape(r['value'])}</pre></section>" for r in rows)
    return f"<!doctype html><html><body>{body or '<p>No findings.</p>'}</body></html>"
