"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: name, module, function, name of the SQL there or None
_ALL = (
    ("op1_simhash", "simhash", "op1", None),
    ("op2_quality", "quality", "op2", None),
    ("op3_toxicity", "toxicity", "op3", None),
    ("op4_decontaminate", "decontaminate", "op4", None),
    ("op5_chat", "chat", "op5", None),
    ("op6_media", "media", "op6", None),
    ("op7_pii", "pii", "op7", None),
    ("op8_language", "language", "op8", None),
    ("op9_suffix_dedup", "suffixes", "op9", None),
    ("op10_mixing", "mixing", "op10", "OP10_SQL"),
    ("op11_runs", "runs", "op11", None),
    ("op12_rules", "rules", "op12", None),
    ("op13_repair", "repair", "op13", None),
)


def _module(name: str):
    return importlib.import_module(f"brindle.llm.{name}")


def queries() -> dict:
    return {name: getattr(_module(mod), fn) for name, mod, fn, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(mod), sql) for name, mod, _, sql in _ALL if sql}
