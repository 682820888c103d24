"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from scrollmill.llm import byte_bpe, decontaminate, infill, langid, line_dedup, mixing, prefix_trie, secrets, simhash, token_files, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_secrets": secrets.op2_secrets,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_language_id": langid.op4_language_id,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_warc": warc.op6_warc,
        "op7_simhash": simhash.op7_simhash,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_topk": topk.op9_topk,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op6_warc": warc.ORACLE_SQL,
        "op9_topk": topk.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_fill_in_middle": infill.ORACLE_SQL,
        "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    }
