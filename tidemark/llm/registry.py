"""The subpackage's queries and, where SQL can express them, their SQL."""

from tidemark.llm import balanced, chat, decontaminate, fingerprints, licenses, lm, manifest, near, packing, quality, substrings, toxicity, whitening

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_minhash_near_dedup": near.op9_minhash_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_balanced_packing": balanced.op11_balanced_packing,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op2_substring_dedup": substrings.OP2_SQL,
    "op3_license_scans": licenses.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
