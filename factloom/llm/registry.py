"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from . import bpe, jaccard_join, license_scans, media_avi, mixing, packing, quality_rules, substring_dedup, toxicity, url_filters


def queries() -> dict:
    found = [
        packing.op1_token_packing, substring_dedup.op2_substring_dedup, url_filters.op3_url_filters, quality_rules.op4_quality_divergence,
        mixing.op5_source_mixing, jaccard_join.op6_ngram_jaccard, bpe.op7_byte_level_bpe, toxicity.op8_toxicity_fm, media_avi.op9_media_avi,
        license_scans.op10_license_scans,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring_dedup.OP2_SQL, "op5_source_mixing": mixing.OP5_SQL, "op6_ngram_jaccard": jaccard_join.OP6_SQL}
