"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from clientele.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, prefix_trie, quality, simhash, spelling, substring_dedup, token_files, topk, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_topk_search": topk.op7_topk_search,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_token_files": token_files.op9_token_files,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op7_topk_search": topk.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_spelling_variants": spelling.SQL,
}
