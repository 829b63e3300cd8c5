"""The registered queries of this subpackage."""

from __future__ import annotations

from quillgraph.llm import bpe, decontaminate, licenses, minhash, quality, sharding, substring_dedup, suffix_dedup, toxicity, urls


def queries() -> dict:
    return {
        "op1_license_scans": licenses.op1_license_scans,
        "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_url_filters": urls.op5_url_filters,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_sharding": sharding.op9_sharding,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op1_license_scans": licenses.oracle(),
        "op2_minhash_near_dedup": minhash.ORACLE_SQL,
        "op4_quality_rules": quality.ORACLE_SQL,
        "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    }
