"""Cosine similarity of two embedding sets paired by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.vectors import cosine, cosine_error


def pair_similarity(a: DataFrame, b: DataFrame, key: str = "name", vector: str = "embedding") -> DataFrame:
    """Similarity per common name; pairs that cannot be scored carry the reason instead."""
    both = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    return both.select(
        key,
        cosine(F.col("_a"), F.col("_b")).alias("similarity"),
        cosine_error(F.col("_a"), F.col("_b")).alias("error"),
    )


def mean_similarity(pairs: DataFrame) -> DataFrame:
    """Mean over the scored pairs; null without any."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count("similarity").alias("n_scored"),
        F.avg("similarity").alias("mean_similarity"),
    )
