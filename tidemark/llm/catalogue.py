"""The queries of this subpackage and the SQL that some of them have."""

from tidemark.llm import chat, decontamination, importance, language, licenses, line_dedup, merkle, packing, quality, secret_scan, simhash, suffix_dedup, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_language_id": language.op3_language_id,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_chat_format": chat.op6_chat_format,
    "op7_pack_sequences": packing.op7_pack_sequences,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES = {"op2_quality_rules": quality.SQL, "op10_license_scan": licenses.SQL, "op12_merkle_manifest": merkle.SQL, "op13_importance_resampling": importance.SQL}
