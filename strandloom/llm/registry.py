"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from strandloom.llm import decontaminate, html, language_model, media, mixing, oracle, packing, pii, prefix_trie, simhash, spelling, suffixes, toxicity, viterbi

QUERIES = {
    "op1_telephony": media.op1_telephony,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_ngram_trie": language_model.op3_ngram_trie,
    "op4_viterbi_counts": viterbi.op4_viterbi_counts,
    "op5_simhash_pigeonring": simhash.op5_simhash_pigeonring,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_visible_text": html.op7_visible_text,
    "op8_personal_data": pii.op8_personal_data,
    "op9_latent_decontamination": decontaminate.op9_latent_decontamination,
    "op10_fair_queueing": mixing.op10_fair_queueing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_best_fit_shards": packing.op12_best_fit_shards,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op10_fair_queueing": oracle.FAIR_QUEUEING,
    "op11_prefix_trie": oracle.PREFIX_TRIE,
    "op12_best_fit_shards": oracle.BEST_FIT_SHARDS,
    "op13_spelling_variants": oracle.SPELLING_VARIANTS,
}
