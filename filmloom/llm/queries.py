"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, lm_scoring, mixing, ngram_join, nn_descent, packing, period_runs, pii, quality, suffix_dedup, token_counts, url_filter, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_pii": pii.op9_pii,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_period_runs": period_runs.op11_period_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_nn_descent": nn_descent.op13_nn_descent,
}

ORACLE = {
    "op4_quality_rules": quality.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
}
