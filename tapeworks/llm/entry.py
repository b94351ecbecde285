"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from tapeworks.llm import bpe, exact_dedup, langid, licenses, near_dedup, packing, pii, quality_rules, substring_dedup, toxicity

MODULES = [licenses, substring_dedup, toxicity, near_dedup, exact_dedup, bpe, quality_rules, langid, pii, packing]
QUERIES = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}
ORACLE_SQL = {name: m.SQL for m in MODULES if getattr(m, "SQL", None) for name in vars(m) if name.startswith("op") and name[2:3].isdigit()}
