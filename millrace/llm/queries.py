"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from millrace.llm import decontaminate, exact_dedup, importance, line_dedup, lm_score, mixing, near_dedup, prefix_trie, quality, sentence_pieces, sharding, url_filter, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc_derivatives": warc.op5_warc_derivatives,
    "op6_sampled_splitters": sharding.op6_sampled_splitters,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sentence_pieces": sentence_pieces.op9_sentence_pieces,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_importance": importance.op12_importance,
    "op13_mixing": mixing.op13_mixing,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_warc_derivatives": warc.OP5_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
}
