"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chunks, collisions, covertree, divergence, forest, langid, lmscore, mixing, packing, rans, simhash, suffixes, templates

QUERIES = {
    "op1_prefix_forest": forest.op1_prefix_forest,
    "op2_mixed_sources": mixing.op2_mixed_sources,
    "op3_context_mixing": lmscore.op3_context_mixing,
    "op4_collision_counting": collisions.op4_collision_counting,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_simhash_trie_join": simhash.op6_simhash_trie_join,
    "op7_gear_chunk_dedup": chunks.op7_gear_chunk_dedup,
    "op8_rans_token_files": rans.op8_rans_token_files,
    "op9_language_mixture": langid.op9_language_mixture,
    "op10_harmonic_packing": packing.op10_harmonic_packing,
    "op11_pair_merge_divergence": divergence.op11_pair_merge_divergence,
    "op12_path_templates": templates.op12_path_templates,
    "op13_cover_tree_codes": covertree.op13_cover_tree_codes,
}

ORACLES: dict[str, str] = {
    "op2_mixed_sources": mixing.SQL,
    "op11_pair_merge_divergence": divergence.SQL,
    "op12_path_templates": templates.SQL,
    "op13_cover_tree_codes": covertree.SQL,
}
