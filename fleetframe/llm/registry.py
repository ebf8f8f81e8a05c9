"""Registered queries of the training-data operators and their SQL counterparts."""

from . import (
    archives, decontamination, innerproducts, jaccard, merkle, packing, privacy, quality, scoring, sharding, spelling, substrings, suffixes,
)

QUERIES = {
    "op1_wu_manber": decontamination.op1_wu_manber,
    "op2_multi_length_packing": packing.op2_multi_length_packing,
    "op3_context_tree_weighting": scoring.op3_context_tree_weighting,
    "op4_token_combination_join": jaccard.op4_token_combination_join,
    "op5_semi_markov_field": privacy.op5_semi_markov_field,
    "op6_fixed_block_anchors": substrings.op6_fixed_block_anchors,
    "op7_arc_to_warc": archives.op7_arc_to_warc,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_bucket_pointer_refinement": suffixes.op9_bucket_pointer_refinement,
    "op10_hilbert_shards": sharding.op10_hilbert_shards,
    "op11_dense_prefix_suffix": spelling.op11_dense_prefix_suffix,
    "op12_dag_descent": merkle.op12_dag_descent,
    "op13_norm_sorted_products": innerproducts.op13_norm_sorted_products,
}
ORACLE = {
    "op1_wu_manber": decontamination.SQL,
    "op6_fixed_block_anchors": substrings.SQL,
    "op7_arc_to_warc": archives.SQL,
    "op8_quality_rules": quality.SQL,
    "op11_dense_prefix_suffix": spelling.SQL,
    "op12_dag_descent": merkle.SQL,
    "op13_norm_sorted_products": innerproducts.SQL,
}
