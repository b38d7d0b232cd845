"""Chunk a token table, decode each context, stitch the signal; and speaker similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators.inference import Predictor, infer_stage
from voxframe.operators.sequence import Chunking, chunk_windows, stitch
from voxframe.operators.similarity import mean_similarity, pair_similarity
from voxframe.sources.catalog import scan_embeddings


def chunk_and_stitch(
    tokens: DataFrame,
    decode: Callable[[Column], Column] | Callable[[], Predictor],
    key: str = "utt_id",
    seq: str = "seq",
    token: str = "token",
    n_ref: str | None = None,
    size: Chunking = Chunking(),
    native: bool = True,
    align_tail: bool = False,
) -> DataFrame:
    """The signal of every sequence, one row per block of ``size.stride`` samples.

    ``decode`` maps a context's tokens to ``size.hop`` samples each: a column expression, or with
    ``native=False`` the maker of a predictor from ``tokens`` to ``samples``.
    """
    chunks = chunk_windows(tokens, key, seq, token, n_ref, size)
    if native:
        decoded = chunks.withColumn("samples", decode(F.col("tokens")))
    else:
        decoded = infer_stage(chunks, decode, ["tokens"], "samples array<double>", on_error="raise")
    return stitch(decoded, key, "samples", size, align_tail=align_tail)


def speaker_similarity(spark: SparkSession, a: str, b: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Similarity per name of two embedding tables, and its mean."""
    pairs = pair_similarity(scan_embeddings(spark, a, name), scan_embeddings(spark, b, name))
    return pairs, mean_similarity(pairs)
