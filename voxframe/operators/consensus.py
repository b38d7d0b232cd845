"""One transcript out of several by aligned voting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import strip_ws, words
from voxframe.functions.voting import aligned_slots, longest_first, vote
from voxframe.operators.pairing import greatest_rows
from voxframe.session import spread


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts, without null and blank ones."""
    return df.withColumn(text, strip_ws(F.col(text))).where(F.col(text) != "")


def _before(number: Column, rank: Column) -> Column:
    """One number by which larger numbers come first, then lower ranks; ranks are below 2^31."""
    return F.shiftleft(number.cast("bigint"), 31) + (F.lit((1 << 31) - 1) - rank)


def longest_transcript(df: DataFrame, key: str = "utt_id", text: str = "text", rank: str = "rank") -> DataFrame:
    """Long form: the transcript with most words per key, the lowest rank on ties."""
    order = _before(F.size(words(F.col(text))), F.col(rank))
    return greatest_rows(df, key, [order]).select(key, rank, text)


def vote_tokens(
    df: DataFrame, key: str | Sequence[str] = "utt_id", pos: str = "pos", word: str = "word", rank: str = "rank"
) -> DataFrame:
    """Long form: most frequent lower-cased word per (key, position), ties to the lowest rank.

    Counting is keyed by position, so one long utterance is spread over the cluster.
    """
    keys = [*([key] if isinstance(key, str) else key), pos]
    said = df.where(F.col(word) != "").select(*keys, F.lower(word).alias(word), rank)
    counts = said.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_rank"))
    return greatest_rows(counts, keys, [_before(F.col("_n"), F.col("_rank"))]).select(*keys, word)


def join_tokens(df: DataFrame, key: str | Sequence[str] = "utt_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """Words per key back to one text in position order; one row holds one transcript."""
    keys = [key] if isinstance(key, str) else list(key)
    ordered = F.array_sort(F.collect_list(F.struct(pos, word)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda t: t[word]), " ").alias("text"))


def merge_transcripts(
    df: DataFrame, systems: Sequence[str], out: str = "merged", compat: bool = False
) -> DataFrame:
    """Adds the voted transcript of the given columns (in that order); rows never move.

    Blank transcripts take no part; with none left the result is '', a single one is kept as it
    is. Otherwise the longest is the reference the others are aligned to. By default the vote is
    held at each reference position; ``compat`` votes over alignment entries instead.
    """
    texts = F.filter(
        F.array(*[strip_ws(F.col(s)) for s in systems]), lambda t: t.isNotNull() & (t != "")
    )
    base = spread(df, heavy=True).withColumn("_texts", texts)
    base = base.withColumn("_ref_at", F.when(F.size("_texts") > 1, longest_first(F.col("_texts"))))
    base = base.withColumn("_ref", words(F.get("_texts", F.col("_ref_at"))))
    slots = []
    for i in range(len(systems)):
        own = words(F.get("_texts", F.lit(i)))
        aligned = aligned_slots(F.col("_ref"), F.col(f"_words_{i}"), compat)
        base = base.withColumn(f"_words_{i}", F.when(F.col("_ref_at").isNotNull(), own)).withColumn(
            f"_aligned_{i}", aligned
        )
        slots.append(F.when(F.col("_ref_at") == i, F.col("_ref")).otherwise(F.col(f"_aligned_{i}")))
    voted = F.array_join(vote(slots), " ")
    merged = (
        F.when(F.size("_texts") == 0, F.lit(""))
        .when(F.size("_texts") == 1, F.get("_texts", F.lit(0)))
        .otherwise(voted)
    )
    return base.select(*df.columns, merged.alias(out))
