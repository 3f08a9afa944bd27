"""The training-corpus pipeline: its stages, run(spark, sf_dir) and SQL, from the optional subpackage."""

from regioscope.llm.pipeline import ORACLE_SQL, STAGES, benchmark, near_duplicates, pack, quality, run, substrings

__all__ = ["ORACLE_SQL", "STAGES", "benchmark", "near_duplicates", "pack", "quality", "run", "substrings"]
