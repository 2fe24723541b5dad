"""The registered queries of this package and their SQL."""

from __future__ import annotations

from runlake.llm import fingerprints, fm_index, jaccard, lines, minhash, mixing, pieces, prefix_trie, quality, repair, sharding, suffix_arrays, token_files

LLM_QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_fm_index_dedup": fm_index.op3_fm_index_dedup,
    "op4_suffix_array_dedup": suffix_arrays.op4_suffix_array_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_token_files": token_files.op8_token_files,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_minhash_dedup": minhash.op13_minhash_dedup,
}

LLM_ORACLES = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op3_fm_index_dedup": fm_index.OP3_SQL,
    "op4_suffix_array_dedup": suffix_arrays.OP4_SQL,
    "op6_fingerprints": fingerprints.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_minhash_dedup": minhash.OP13_SQL,
}
