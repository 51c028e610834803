"""Registered queries of the operators and their SQL where there is any."""

from __future__ import annotations

from quillmask.llm import alignment, decontamination, hmm, languages, licences, mixing, negatives, pieces, prob_minhash, token_counts, topk, toxicity, winnowing

QUERIES = {
    "op1_hmm": hmm.op1_hmm,
    "op2_token_cache": token_counts.op2_token_cache,
    "op3_prob_minhash": prob_minhash.op3_prob_minhash,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pareto_mix": mixing.op5_pareto_mix,
    "op6_top_k": topk.op6_top_k,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_language_mixture": languages.op9_language_mixture,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_slot_negatives": negatives.op11_slot_negatives,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_prefix_join": decontamination.op13_prefix_join,
}

ORACLES = {
    "op6_top_k": topk.ORACLE,
    "op5_pareto_mix": mixing.ORACLE,
    "op11_slot_negatives": negatives.ORACLE,
    "op13_prefix_join": decontamination.ORACLE,
}
