"""Queries of this subpackage and their SQL, for registration by the entry module."""

from __future__ import annotations

from . import decontaminate, licenses, lm_score, ngram_join, packing, quality_rules, recompression, suffix_repeats, toxicity, warc_index

QUERIES = {
    "op1_warc_index_merge": warc_index.query,
    "op2_adaptive_prefix_join": ngram_join.query,
    "op3_recompression_spans": recompression.query,
    "op4_toxicity_nb_linear": toxicity.query,
    "op5_unbounded_ngram_score": lm_score.query,
    "op6_shortest_pack_first": packing.query,
    "op7_positional_decontamination": decontaminate.query,
    "op8_license_scan": licenses.query,
    "op9_rule_bitmask_ledger": quality_rules.query,
    "op10_maximal_repeats": suffix_repeats.query,
    "jaccard_pairs": ngram_join.pairs_query,
    "rule_ablation": quality_rules.ablation_query,
    "benchmark_ngram_score": lm_score.benchmark_query,
}

ORACLES = {
    "op1_warc_index_merge": warc_index.ORACLE,
    "op2_adaptive_prefix_join": ngram_join.ORACLE,
    "jaccard_pairs": ngram_join.PAIRS_ORACLE,
    "op3_recompression_spans": recompression.ORACLE,
    "op7_positional_decontamination": decontaminate.ORACLE,
    "op9_rule_bitmask_ledger": quality_rules.ORACLE,
    "rule_ablation": quality_rules.ABLATION_ORACLE,
}
