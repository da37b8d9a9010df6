"""The corpus pipeline: quality rules, near duplicates, benchmark passages, mix of sources, shards.

The stages are those of tessera.llm.pipeline, where their handling of nulls, ties and empty tables is stated.
"""

from __future__ import annotations

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
