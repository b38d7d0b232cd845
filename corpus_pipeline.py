"""From raw documents to token ids: the stages in order, each written as Parquet and read back as the next one's input.

A stage takes all that its predecessor kept. Every stage but the last returns the columns of its input. Rows with null
or empty texts pass all of them; rows without doc_id do too, as nothing can be said about them by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, line_dedup, minhash, queries, sentencepiece, toxicity
from voxframe.llm.common import stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the model learns from the labelled rows that op1 learns from.

    Texts without a letter or digit (null, empty, blank, punctuation) say nothing and stay, whatever the share of toxic labels.
    """
    score = "toxicity score of this stage"
    scored = toxicity.score_toxicity(docs, queries.toxicity_model(spark, sf_dir), score)
    silent = F.col("text").isNull() | ~F.col("text").rlike(r"[\p{L}\p{N}]")
    return scored.where(silent | (F.col(score) < toxicity.THRESHOLD)).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a document that consisted of them goes. n_chars follows the text."""
    removed = "lines removed by this stage"
    cut = line_dedup.dedup_lines(docs, before="lines before this stage", removed=removed)
    kept = cut.where((F.col(removed) == 0) | F.col("text").rlike(line_dedup.NOT_BLANK))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids, their number, and whether they decode to its text."""
    encoded = sentencepiece.encode(docs.select("doc_id", "text"), queries.piece_vocabulary(), "ids", "round_trip")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", lines_once),
    ("near duplicates", no_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("sentencepiece", pieces),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
