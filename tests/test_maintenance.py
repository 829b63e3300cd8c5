import json

from pyspark.sql import functions as F

from quillgraph.plans import catalogue
from quillgraph.sources import sinks
from quillgraph.sources.readers import discover, load_rules
from quillgraph.streaming.incremental import IncrementalScan


def test_incremental_equals_full(spark, tmp_path):
    schema = "path string, generation long, hash string, n long"
    scan = IncrementalScan(spark, str(tmp_path / "scan"), lambda rows: rows.where("n > 0").select(F.col("path").alias("file"), "n"))
    scan.batch(spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 2), ("c", 1, "z", 0)], schema), 0)
    scan.batch(spark.createDataFrame([("a", 2, "x2", 5), ("a", 0, "old", 9), ("b", 2, None, None)], schema), 1)
    assert sorted(map(tuple, scan.findings().collect())) == [("a", 5)]
    # a scan that starts again goes on from the folder, also where batches are numbered from 0 again
    again = IncrementalScan(spark, scan.path, scan.evaluate)
    again.batch(spark.createDataFrame([("d", 1, "w", 7), ("a", 3, "x2", 6)], schema), 0)
    assert sorted(map(tuple, again.findings().collect())) == [("a", 5), ("d", 7)]
    # under another rule set what comes is judged anew, changed or not
    other = IncrementalScan(spark, scan.path, lambda rows: rows.where("n > 6").select(F.col("path").alias("file"), "n"), "v2")
    other.batch(spark.createDataFrame([("a", 3, "x2", 6)], schema), 0)
    assert sorted(map(tuple, other.findings().collect())) == [("d", 7)]


def test_discover_and_rules(spark, tmp_path):
    src = tmp_path / "src"
    for name in ("a.py", "b.txt", "vendor/c.go", "d/e.rs", ".git/f.c"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text("x")
    rows = discover(spark, str(src)).select("path", "lang").collect()
    assert sorted((r["path"].rpartition("/")[2], r["lang"]) for r in rows) == [("a.py", "python"), ("e.rs", "rust")]
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "one.rule").write_text('rule "a" { find n: Call }')
    assert [r.id for r in load_rules(spark, str(tmp_path / "rules")).rules] == ["a"]


def test_sinks(spark):
    rows = [("r", "high", "a|b", ["t"], "f", 1, 2, 0, 1, [1])]
    schema = "rule_id string, severity string, message string, tags array<string>, file string, line long, end_line long, column long, end_column long, matched_nodes array<long>"
    f = spark.createDataFrame(rows, schema)
    assert json.loads(sinks.sarif_report(f))["runs"][0]["results"][0]["level"] == "error"
    assert "a\\|b" in sinks.to_markdown(f).first()["value"]
    assert "1-2" in sinks.html_report(f)
    assert sinks.to_markdown(f.limit(0)).count() == 0


def test_catalogue_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
