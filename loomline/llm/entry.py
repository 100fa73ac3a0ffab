"""The queries of this subpackage and their SQL, where SQL can express them. What each makes of odd rows is said by its module."""

from __future__ import annotations

from . import decontam, exact, langid, lm, neardup, packing, pii, shard, substring, urls

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_url_filter": urls.op3_url_filter,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_personal_data": pii.op5_personal_data,
    "op6_sharding": shard.op6_sharding,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_decontamination": decontam.SQL,
    "op3_url_filter": urls.SQL,
    "op4_substring_dedup": substring.SQL,
    "op7_near_duplicates": neardup.SQL,
    "op8_exact_dedup": exact.SQL,
}
