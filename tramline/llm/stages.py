"""The stages of the corpus pipeline, one operator each.

Defined cases: a null or empty text is scored like any other, is alone among
near copies, loses no words and gets one row without a sequence; a null id is
never learned from, is no copy of another and removes nothing; rows with equal
ids stay or go together where copies are judged, and never remove words from
each other; ties go to the smallest id; very long texts count whole; an empty
table gives an empty result; extra columns are kept, whatever their names, but
by the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, packing, quality, shared, substring, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7."""
    model = quality.fit(quality.statistics(docs), shared.table(spark, sf_dir, "labels"))
    score = shared.unused("score", docs.columns)
    return docs.withColumn(score, quality.score_column(model, "text")).where(F.col(score) >= 0.7).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5."""
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    score = shared.unused("score", docs.columns)
    return docs.withColumn(score, toxicity.score_column(model, "text")).where(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return minhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start in an earlier one.

    A text that loses words is its remaining words joined by one space, and its
    ``n_chars``, where there is such a column, follows; other texts stay as they are.
    """
    into = shared.unused("dedup", docs.columns)
    out = substring.remove_repeats(docs, into=into)
    lost = F.col(f"{into}.n_removed") > 0
    out = out.withColumn("text", F.when(lost, F.col(f"{into}.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, and the sequence that holds it."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str, stages: Sequence[tuple[str, Stage]]) -> DataFrame:
    """Apply the stages in order; what one keeps is written, and reread by the next."""
    docs = shared.table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(stages):
            docs = shared.written(docs, f"stage-{at}")
    return docs
