"""A corpus pipeline: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.stages import STAGES, run_stages

#: Language ID, ProbMinHash and SentencePiece encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    return run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
