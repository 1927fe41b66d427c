"""The pipeline over raw documents; its stages are in the subpackage of the operators."""

from postscreen.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
