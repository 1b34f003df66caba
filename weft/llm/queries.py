"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package
_MODULES = {
    "op1_topk": "topk",
    "op2_language_id": "langid",
    "op3_mixing": "mixing",
    "op4_jaccard_join": "jaccardjoin",
    "op5_exact_dedup": "exactdedup",
    "op6_packing": "packing",
    "op7_warc": "warc",
    "op8_substring_dedup": "substrings",
    "op9_url_filters": "urlfilter",
    "op10_lm_scoring": "lmscore",
    "op11_simhash": "simhash",
    "op12_token_alignment": "alignment",
    "op13_periodic_runs": "periodic",
}


def queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql():
    out = {}
    for module in sorted(set(_MODULES.values())):
        out |= getattr(import_module(f"{__package__}.{module}"), "ORACLE", {})
    return out
