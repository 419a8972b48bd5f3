"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from flightframe.llm import bpe, decontaminate, divergence, line_dedup, prefix_trie, quality, simhash, substring, telephony, top_k, toxicity, url_filter, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_warc_derivatives": warc.op4_warc_derivatives,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_simhash": simhash.op6_simhash,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_substring": substring.op8_substring,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_telephony": telephony.op10_telephony,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_divergence": divergence.op12_divergence,
    "op13_top_k": top_k.op13_top_k,
}

ORACLES = {
    "op4_warc_derivatives": warc.OP4_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_top_k": top_k.OP13_SQL,
}
