"""The corpus queries over the test tables, and their SQL where it can say the same."""

from __future__ import annotations

import importlib
import importlib.util

#: Modules that hold QUERIES and ORACLE_SQL.
_PARTS = ["q_exact_dedup", "q_simhash", "q_decontaminate", "q_warc", "q_substrings", "q_line_dedup", "q_packing", "q_toxicity", "q_pii", "q_conversations", "q_spelling", "q_sketch_dedup"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in _PARTS:
    _part = importlib.import_module(f"patternscore.llm.{_name}")
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
