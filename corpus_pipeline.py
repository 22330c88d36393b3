"""The corpus pipeline; it lives in the training-data subpackage."""

from docmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
