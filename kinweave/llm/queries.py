"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from kinweave.llm import contamination, licenses, linededup, packing, pii, quality, sharding, simhash, toxicity, urls

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_benchmark_decontamination": contamination.op6_benchmark_decontamination,
    "op7_url_filters": urls.op7_url_filters,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
}

ORACLE_SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op7_url_filters": urls.OP7_SQL,
}
