"""Queries of the operators with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from strataloom.llm import chunks, decontaminate, langid, media, packing, quality, repeats, sharding, simhash, toxicity

QUERIES = {
    "op8_crf_language_id": langid.op8_query,
    "op2_nnpu_quality": quality.op2_query,
    "op1_levenshtein_toxicity": toxicity.op1_query,
    "op5_gear_chunk_dedup": chunks.op5_query,
    "op3_run_length_index": repeats.op3_query,
    "op6_best_fit_packing": packing.op6_query,
    "op4_balanced_label_propagation": sharding.op4_query,
    "op7_simhash_pigeonring": simhash.op7_query,
    "op9_avi_motion_jpeg": media.op9_query,
    "op10_benchmark_decontamination": decontaminate.op10_query,
}
ORACLES = {
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
}
