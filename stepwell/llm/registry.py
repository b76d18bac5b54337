"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from stepwell.llm import exact_dedup, html_extract, lm_score, mixing, packing, pii, quality_rules, sharding, simhash, substring


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": pii.op1_pii,
        "op2_html_extract": html_extract.op2_html_extract,
        "op3_packing": packing.op3_packing,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_mixing": mixing.op5_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_substring": substring.op10_substring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.OP8_SQL}
