"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from lanewise.llm import centroids, chat, divergence, exact_dedup, language_id, packing, pieces, quality, repeats, simhash, toxicity, windows, winnow

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_chat_formatting": chat.op2,
    "op3_toxicity": toxicity.op3,
    "op4_suffix_array_dedup": repeats.op4,
    "op5_language_id": language_id.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_document_fingerprints": winnow.op9,
    "op10_quality": quality.op10,
    "op11_packing": windows.op11,
    "op12_source_divergence": divergence.op12,
    "op13_centroid_clustering": centroids.op13,
}

ORACLES = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
