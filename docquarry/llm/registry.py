"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import importlib

#: query name -> module of this subpackage with query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op2_suffix_dedup": "columnwise",
    "op1_language": "language",
    "op3_licences": "licences",
    "op4_lm_score": "scoring",
    "op5_packing": "packing",
    "op6_substrings": "recompression",
    "op7_neardup": "neardup",
    "op8_decontamination": "decontaminate",
    "op9_sharding": "sharding",
    "op10_quality": "quality",
    "op11_whitening": "whitening",
    "op12_neighbours": "neighbours",
    "op13_prefix_trie": "prefixtrie",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
