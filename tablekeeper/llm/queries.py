"""Registered queries of the numbered operators and the pipeline, and their SQL where SQL can express them."""

import corpus_pipeline
from tablekeeper.llm import (
    decontaminate,
    filter_audit,
    jaccard_join,
    lm_trie,
    mixing,
    pii,
    quality_rules,
    token_cache,
    tool_calls,
    toxicity,
    url_filter,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_lm_score": lm_trie.op2_lm_score,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_token_counts": token_cache.op4_token_counts,
    "op5_personal_data": pii.op5_personal_data,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_tool_calls": tool_calls.op7_tool_calls,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_arc_to_warc": warc.op10_arc_to_warc,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_arc_to_warc": warc.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_url_filter": url_filter.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
