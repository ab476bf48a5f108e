"""Corpus preparation: toxicity, line dedup, near-dedup, secret scan, packing."""

from __future__ import annotations

from headroom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
