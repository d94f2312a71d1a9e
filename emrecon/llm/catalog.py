"""Queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from emrecon.llm import alignment, bpe, chat_format, chosen_path, exact_dedup, fill_in_middle, jaccard_join, packing, quality_fm, quality_rules, sharding, token_files, toxicity

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": token_files.op3_token_counts,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_bpe": bpe.op7_bpe,
    "op8_quality_classifier": quality_fm.op8_quality_classifier,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_alignment": alignment.op11_alignment,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_minhash_near_dedup": chosen_path.op13_minhash_near_dedup,
}

ORACLES = {
    "op1_chat_formatting": chat_format.ORACLE,
    "op4_ngram_jaccard_join": jaccard_join.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_minhash_near_dedup": chosen_path.ORACLE,
}
