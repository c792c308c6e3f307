"""Queries of the training-data operators, and the SQL that states the same results where SQL can."""

from __future__ import annotations

from docquery.llm import conversations, decontamination, langid, licenses, maxscore, merkle, mixing, near_dedup, packing, quality, substring_dedup, token_output, warc

QUERIES = {
    "op1_exact_top_k": maxscore.op1_exact_top_k,
    "op2_language_id": langid.op2_language_id,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_token_output": token_output.op4_token_output,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_warc": warc.op6_warc,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_suffix_array_dedup": substring_dedup.op8_suffix_array_dedup,
    "op9_benchmark_decontamination": decontamination.op9_benchmark_decontamination,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_conversation_trie": conversations.op11_conversation_trie,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": maxscore.ORACLE,
    "op3_minhash_near_dedup": near_dedup.ORACLE,
    "op9_benchmark_decontamination": decontamination.ORACLE,
    "op11_conversation_trie": conversations.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
