"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from capsift.llm import chat, filter_audit, langid, licenses, lines, merkle, mixing, packing, passages, quality, simhash, token_files, topk


def queries() -> dict:
    return {
        "op1_hierarchical_budget": mixing.op1_hierarchical_budget,
        "op2_simhash": simhash.op2_simhash,
        "op3_wavelet_tokens": token_files.op3_wavelet_tokens,
        "op4_weak_supervision": quality.op4_weak_supervision,
        "op5_viterbi_language": langid.op5_viterbi_language,
        "op6_content_parts": chat.op6_content_parts,
        "op7_pivot_table": topk.op7_pivot_table,
        "op8_relative_lz": passages.op8_relative_lz,
        "op9_vector_packing": packing.op9_vector_packing,
        "packed_conversations": packing.packed_conversations,
        "op10_deletion_neighbourhood": lines.op10_deletion_neighbourhood,
        "op11_license_scan": licenses.op11_license_scan,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hierarchical_budget": mixing.sql(),
        "op4_weak_supervision": quality.sql(),
        "op6_content_parts": chat.sql(),
        "op7_pivot_table": topk.sql(),
        "op10_deletion_neighbourhood": lines.sql(),
        "op12_merkle_manifest": merkle.sql(),
        "op13_filter_audit": filter_audit.sql(),
    }
