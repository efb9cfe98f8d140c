"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_simhash": "simhash",
    "op2_langid": "langid",
    "op3_topk": "topk",
    "op4_packing": "packing",
    "op5_lm": "lm",
    "op6_repeats": "repeats",
    "op7_ann": "ann",
    "op8_quality": "quality",
    "op9_sharding": "sharding",
    "op10_mixing": "mixing",
}


def queries() -> dict:
    return {name: importlib.import_module(f".{module}", __package__).query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    modules = {name: importlib.import_module(f".{module}", __package__) for name, module in MODULES.items()}
    return {name: m.ORACLE for name, m in modules.items() if hasattr(m, "ORACLE")}
