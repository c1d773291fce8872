"""The corpus pipeline (see marquee.llm.pipeline)."""

from marquee.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
