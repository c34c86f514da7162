"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import alignment, decontaminate, jaccard_join, language_id, license_scan, line_dedup, merkle, packing, quality, secrets, simhash, token_store, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_token_store": token_store.op7_token_store,
    "op8_language_id": language_id.op8_language_id,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_alignment": alignment.op11_alignment,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_simhash": simhash.op13_simhash,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
