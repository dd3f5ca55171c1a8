"""Queries and DuckDB SQL of this subpackage, for the entry module."""

import corpus_pipeline
from lettermill.llm import bpe, chat, divergence, embedding, html_extract, line_dedup, mixing, near_dup, quality, sharding, suffix_dedup, url_filter, vector_codes

QUERIES = {
    "op1_site_line_dedup": line_dedup.op1_site_line_dedup,
    "op2_inverted_multi_index": embedding.op2_inverted_multi_index,
    "op3_boosted_quality": quality.op3_boosted_quality,
    "op4_trie_bpe": bpe.op4_trie_bpe,
    "op5_hierarchical_mix": mixing.op5_hierarchical_mix,
    "op6_perspective_rotation": chat.op6_perspective_rotation,
    "op7_rendezvous_sharding": sharding.op7_rendezvous_sharding,
    "op8_lsh_forest": near_dup.op8_lsh_forest,
    "op9_bloom_cascade": url_filter.op9_bloom_cascade,
    "op10_template_extraction": html_extract.op10_template_extraction,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_site_line_dedup": line_dedup.OP1_SQL,
    "op5_hierarchical_mix": mixing.OP5_SQL,
    "op6_perspective_rotation": chat.OP6_SQL,
    "op7_rendezvous_sharding": sharding.OP7_SQL,
    "op9_bloom_cascade": url_filter.OP9_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_suffix_dedup": suffix_dedup.OP13_SQL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}
