"""Scores of transcription systems against references, and their averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.scoring import cer_stats, pair_edits, rate, wer_raw, wer_raw_status, wer_stats
from voxframe.functions.text import normalize_for
from voxframe.session import spread

METRICS = ("wer", "cer", "sub_rate", "del_rate", "ins_rate")


def to_long(df: DataFrame, systems: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, system): ``systems`` maps a system's name to its hypothesis column."""
    wide = df.select(*keep, *[F.col(c).alias(f"_{name}") for name, c in systems.items()])
    pairs = ", ".join(f"'{name}', `_{name}`" for name in systems)
    return wide.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(systems)}, {pairs}) AS (system, hyp)")


def score_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp", compat: bool = False) -> DataFrame:
    """Adds distance, word counts, S/D/I, WER, CER and error rates to normalised pairs.

    A null hypothesis has null scores; ``compat`` scores it as blank.
    """
    other = F.coalesce(F.col(hyp), F.lit("")) if compat else F.col(hyp)
    edited = df.withColumn("_hyp", other).withColumn("_edits", pair_edits(F.col(ref), F.col("_hyp"), compat))
    edits = F.col("_edits")
    stats = edited.withColumn("_w", wer_stats(F.col(ref), F.col("_hyp"), edits, compat)).withColumn(
        "_c", cer_stats(F.col(ref), F.col("_hyp"), edits["char_distance"])
    )
    scored = F.col("_hyp").isNotNull()

    def known(c: Column) -> Column:
        return F.when(scored, c)

    total = F.col("_w.ref_words")
    return stats.select(
        *df.columns,
        known(F.col("_w.distance")).alias("distance"),
        total.alias("ref_words"),
        known(F.col("_w.hyp_words")).alias("hyp_words"),
        known(F.col("_w.substitutions")).alias("substitutions"),
        known(F.col("_w.deletions")).alias("deletions"),
        known(F.col("_w.insertions")).alias("insertions"),
        known(F.col("_w.wer")).alias("wer"),
        known(F.col("_c.cer")).alias("cer"),
        known(rate(F.col("_w.substitutions"), total)).alias("sub_rate"),
        known(rate(F.col("_w.deletions"), total)).alias("del_rate"),
        known(rate(F.col("_w.insertions"), total)).alias("ins_rate"),
    )


def score_systems(
    df: DataFrame,
    systems: Mapping[str, str],
    lang: Column | str = "en",
    key: str | Sequence[str] = "utt_id",
    ref: str = "ref",
    compat: bool = False,
) -> DataFrame:
    """Scores of every system on every utterance, one row each.

    The reference is normalised once, before the systems are unpivoted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keep = [*keys, "_ref", *(["_lang"] if isinstance(lang, Column) else [])]
    wide = df.withColumn("_ref", normalize_for(F.col(ref), lang))
    if isinstance(lang, Column):
        wide = wide.withColumn("_lang", lang)
    pairs = to_long(spread(wide, *keys), systems, keep)
    code = F.col("_lang") if isinstance(lang, Column) else lang
    hyp = normalize_for(F.col("hyp"), code)
    pairs = pairs.select(
        *keys, "system", F.col("_ref").alias("ref"), F.when(F.col("hyp").isNotNull(), hyp).alias("hyp")
    )
    return score_pairs(pairs, "ref", "hyp", compat).drop("ref", "hyp")


def system_summary(scores: DataFrame, systems: Sequence[str]) -> DataFrame:
    """Macro averages x 100 per system; a system without scores keeps a row of nulls."""
    spark = scores.sparkSession
    names = spark.createDataFrame([(s,) for s in systems], "system string")
    means = scores.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count("wer").alias("n_scored"),
        *[(F.avg(m) * 100).alias(m) for m in METRICS],
    )
    return names.join(means, "system", "left").select(
        "system",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
        (F.coalesce("n_files", F.lit(0)) - F.coalesce("n_scored", F.lit(0))).alias("n_missing"),
        *METRICS,
    )


def raw_wer(paired: DataFrame, ref: str = "ref_text", hyp: str = "hyp_text", compat: bool = False) -> DataFrame:
    """WER of un-normalised text for the matched rows of ``pair_left``."""
    matched = F.col("matched")
    return paired.withColumn("wer", F.when(matched, wer_raw(F.col(ref), F.col(hyp), compat))).withColumn(
        "status", F.when(matched, wer_raw_status(F.col(ref))).otherwise(F.lit("no_hypothesis"))
    )


def coverage(scored: DataFrame, strict: bool = True) -> DataFrame:
    """Mean WER of matched pairs and how many references had none; ``strict`` fails without any pair."""
    found = scored.agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if("matched").alias("n_matched"),
        F.count_if(~F.col("matched")).alias("n_unmatched"),
        F.avg("wer").alias("mean_wer"),
    )
    share = F.col("n_unmatched") / F.nullif(F.col("n_refs"), F.lit(0)) * 100
    found = found.withColumn("pct_unmatched", share)
    if not strict:
        return found
    any_pair = F.when(F.col("n_matched") > 0, F.lit(True))
    return found.where(any_pair.otherwise(F.raise_error(F.lit("no matching pairs")).cast("boolean")))
