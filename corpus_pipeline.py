"""The training-data pipeline: STAGES, ORACLE_SQL and run(spark, sf_dir) of ``boxscan.llm.pipeline``."""

from boxscan.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
