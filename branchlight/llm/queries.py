"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from importlib import import_module

#: Module, query and whether the module has its SQL as ORACLE.
_OPERATORS = (
    ("quality", "op1_quality_rules"),
    ("simhash", "op4_simhash_near_dedup"),
    ("suffixdedup", "op2_suffix_dedup"),
    ("licenses", "op3_license_scan"),
    ("secrets", "op5_secret_scan"),
    ("lm", "op6_lm_scoring"),
    ("mixing", "op7_mixing"),
    ("langid", "op8_language_id"),
    ("chat", "op9_chat_format"),
    ("decontaminate", "op10_decontaminate"),
    ("compression", "op11_compression_quality"),
    ("divergence", "op12_source_divergence"),
    ("merkle", "op13_merkle_manifest"),
)


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for module, name in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE", None) for module, name in _OPERATORS}
    return {name: sql for name, sql in found.items() if sql}
