"""Queries and SQL of the corpus operators."""

from . import best_fit_packing, collocations, embedding_dedup, fuzzy_passages, line_dedup, lm_scoring, mixing, near_dedup, periodic_runs, quality_classifier, quality_rules, sentencepiece_codec, toxicity

_MODULES = (quality_classifier, mixing, sentencepiece_codec, fuzzy_passages, near_dedup, embedding_dedup, lm_scoring, toxicity, quality_rules, line_dedup, best_fit_packing, periodic_runs, collocations)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
