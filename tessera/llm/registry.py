"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

import corpus_pipeline
from tessera.llm import decontamination, licenses, oracles, pii, quality_rules, simhash_dedup, source_mixing, substring_dedup, suffix_dedup, token_ids, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_suffix_array_dedup": suffix_dedup.op6_suffix_array_dedup,
    "op7_token_ids": token_ids.op7_token_ids,
    "op8_source_mixing": source_mixing.op8_source_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_decontamination": oracles.OP3, "op5_substring_dedup": oracles.OP5, "op6_suffix_array_dedup": oracles.OP6, "op10_quality_rules": oracles.OP10,
}
ORACLES |= {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
