"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from cloakframe.llm import decontam, host_rules, line_dedup, lm, mixing, quality, secrets, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_language_model": lm.op3_language_model,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_host_rules": host_rules.op6_host_rules,
    "op7_secrets": secrets.op7_secrets,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_host_rules": host_rules.OP6_SQL,
    "op7_secrets": secrets.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
}

if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
