"""The corpus pipeline as a script's module: its stages, its run, and its SQL twin, from the pipeline's own package."""

from quire.llm.pipeline import ORACLE_SQL, STAGES, near_dup_stage, run

__all__ = ["ORACLE_SQL", "STAGES", "near_dup_stage", "run"]
