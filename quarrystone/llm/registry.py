"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from quarrystone.llm import collocations, conversations, decontaminate, jaccard, licences, line_dedup, packing, pseudonyms, quality, repeats, topk, toxicity, warc

QUERIES = {
    "op1_feistel_pseudonyms": pseudonyms.op1_feistel_pseudonyms,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_licences": licences.op3_licences,
    "op4_winnowing": decontaminate.op4_winnowing,
    "op5_ftrl_quality": quality.op5_ftrl_quality,
    "op6_crf_toxicity": toxicity.op6_crf_toxicity,
    "op7_ball_tree": topk.op7_ball_tree,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_repeats": repeats.op13_repeats,
}
ORACLES = {
    "op4_winnowing": decontaminate.ORACLE,
    "op7_ball_tree": topk.ORACLE,
    "op8_ngram_jaccard": jaccard.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_repeats": repeats.ORACLE,
}
