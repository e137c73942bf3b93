"""Corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, packing.

The stages are in ``tributary.llm.pipeline``.
"""

from tributary.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
