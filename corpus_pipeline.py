"""Corpus pipeline: quality, toxicity, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import stages

STAGES = stages.STAGES

#: The stages learn models and sketches, which SQL cannot express; the tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread in between."""
    return stages.run(spark, sf_dir, STAGES)
