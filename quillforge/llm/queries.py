"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillforge.llm import jaccard_join, packing, pii, quality, repeats, topk, toxicity, url_tree, warc_zip, wu_manber

QUERIES = {
    "op1_segments": toxicity.op1_segments,
    "op2_path_templates": url_tree.op2_path_templates,
    "op3_block_top_k": topk.op3_block_top_k,
    "op4_best_fit": packing.op4_best_fit,
    "op5_zip_ranges": warc_zip.op5_zip_ranges,
    "op6_interleave": repeats.op6_interleave,
    "op7_deobfuscation": pii.op7_deobfuscation,
    "op8_wu_manber": wu_manber.op8_wu_manber,
    "op9_empirical_bayes": quality.op9_empirical_bayes,
    "op10_divide_skip": jaccard_join.op10_divide_skip,
}

ORACLE_SQL: dict[str, str] = {
    "op3_block_top_k": topk.ORACLE_SQL,
}
