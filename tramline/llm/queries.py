"""The operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprint, minhash, packing, quality, sentencepiece, shared, substring, suffix, toxicity, urls
from .oracles import ORACLES

#: The public model that op5 encodes with; any identity-normalised model will do.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

RULES = (urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document, removed."""
    out = substring.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, by their number of words, in sequences of five permitted lengths."""
    return packing.pack(_documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document; the smallest id of each is kept."""
    return minhash.near_copies(_documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back.

    The public model is a byte-pair one: ``ids`` are its merges, as the format
    has it; ``viterbi_ids`` are the best path over the same pieces and scores.
    """
    docs = _documents(spark, sf_dir)
    model = sentencepiece.load(spark, PIECE_MODEL)
    coded = docs.withColumn("coded", sentencepiece.encode_both(model, "text"))
    same = [sentencepiece.decode(model, f"coded.{c}").eqNullSafe(F.col("text")) for c in ("merged", "best")]
    return coded.select("doc_id", F.size("coded.merged").alias("n_tokens"), F.col("coded.merged").alias("ids"), same[0].alias("round_trip"), F.col("coded.best").alias("viterbi_ids"), same[1].alias("viterbi_round_trip"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, and decision at 0.7, for every document."""
    stats = quality.statistics(shared.table(spark, sf_dir, "documents"))
    model = quality.fit(stats, shared.table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", (shared.remainder("doc_id", 4) == 2).alias("held_out"), quality.score_stats_column(model, "stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    out = fingerprint.fingerprints(_documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, and decision at 0.5, for every document."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (shared.remainder("doc_id", 5) == 0).alias("held_out"), toxicity.score_column(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in an earlier document, removed."""
    out = suffix.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", F.size("dedup.spans").cast("long").alias("n_spans"), F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 within a label, and their components."""
    return embeddings.near_copies(shared.table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup, op2_best_fit_packing, op3_url_filters, op4_minhash_near_dedup, op5_sentencepiece,
        op6_quality_classifier, op7_document_fingerprints, op8_toxicity, op9_suffix_array_dedup, op10_embedding_near_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
