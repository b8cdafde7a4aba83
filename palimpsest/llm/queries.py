"""The queries opN_<name> and their DuckDB counterparts."""

from __future__ import annotations

from . import embedding_dedup, fingerprints, language, minhash, mixing, packing, quality, suffix_dedup, token_counts, token_output

QUERIES = {
    "op1_fingerprints": fingerprints.fingerprints_query,
    "op2_best_fit_packing": packing.pack_query,
    "op3_token_output": token_output.packed_query,
    "op4_embedding_dedup": embedding_dedup.near_duplicates_query,
    "op5_token_counts": token_counts.count_query,
    "op6_quality": quality.classify_query,
    "op7_suffix_dedup": suffix_dedup.find_repeats_query,
    "op8_minhash": minhash.near_duplicates_query,
    "op9_mixing": mixing.mix_query,
    "op10_language": language.language_query,
}
ORACLES = {"op9_mixing": mixing.ORACLE}
