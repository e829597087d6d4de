"""The corpus pipeline of helixframe.llm: STAGES, run(spark, sf_dir) and ORACLE_SQL."""

from helixframe.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, drop_near_duplicates, drop_repeated_lines, encode, mix_sources, reject_toxic, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "drop_near_duplicates", "drop_repeated_lines", "encode", "mix_sources", "reject_toxic", "run"]
