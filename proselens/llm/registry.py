"""The registered queries of this folder, and their SQL where it can say the same."""

from __future__ import annotations

from . import decontamination, exact, language, lm, mixing, near, pii, quality, ranked, sharding, toxicity, urls, vectors

QUERIES = {
    "op1_lm_bloom": lm.query,
    "op2_quality_forest": quality.query,
    "op3_language_id": language.query,
    "op4_near_join": near.query,
    "op5_kd_sharding": sharding.query,
    "op6_url_trie": urls.query,
    "op7_decontamination": decontamination.query,
    "op8_private_terms": pii.query,
    "op9_toxicity_grammar": toxicity.query,
    "op10_systematic_mixing": mixing.query,
    "op11_radix_dedup": exact.query,
    "op12_block_max_search": ranked.query,
    "op13_annular_codes": vectors.query,
}
ORACLE_SQL = {
    "op4_near_join": near.SQL,
    "op6_url_trie": urls.SQL,
    "op7_decontamination": decontamination.SQL,
    "op10_systematic_mixing": mixing.SQL,
    "op11_radix_dedup": exact.SQL,
    "op12_block_max_search": ranked.SQL,
    "op13_annular_codes": vectors.SQL,
}
