"""Operators for preparing large text corpora: licence scans, deduplication,
decontamination, quality rules, URL filters, tokenising, toxicity and sharding.

Nothing outside this package imports it.  ``queries()`` and ``oracle_sql()``
give the registered queries; each operator's module documents its defined
results for nulls, empty and very long texts, ties and repeated rows.
"""

from quillgraph.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
