"""Queries of the document operators: name -> (callable(spark, folder), SQL or None)."""
from __future__ import annotations

from importlib import import_module

#: (module, query), in the order of the operators.
ENTRIES = [("fingerprint", "op1_fingerprints"), ("bpe", "op2_bpe"), ("ranking", "op3_ranking"), ("sharding", "op4_sharding"),
           ("rules", "op5_quality_rules"), ("mixing", "op6_mixing"), ("counts", "op7_token_counts"), ("jaccard", "op8_jaccard"), ("secrets", "op9_secrets"),
           ("substrings", "op10_substrings"), ("spelling", "op11_spelling"), ("negatives", "op12_hard_negatives"),
           ("decontaminate", "op13_decontaminate")]


def registry() -> dict:
    out = {}
    for module, name in ENTRIES:
        m = import_module(f"{__package__}.{module}")
        out[name] = (getattr(m, name), getattr(m, "SQL", None))
    return out
