"""Joins of references, hypotheses, codes and finished outputs on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_left(ref: DataFrame, hyp: DataFrame, key: str = "utt_id") -> DataFrame:
    """Every reference with its hypothesis, if any; ``matched`` tells them apart."""
    return ref.join(hyp.withColumn("matched", F.lit(True)), key, "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def pair_strict(left: DataFrame, right: DataFrame, key: str = "utt_id") -> DataFrame:
    """Every left row with its partner; running it fails on the first row without one."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    message = F.concat(F.lit("no partner for "), F.col(key).cast("string"))
    checked = F.when(F.col("_found").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("_found"))
    return marked.where(checked).drop("_found")


def pair_inner(left: DataFrame, right: DataFrame, key: str = "utt_id") -> DataFrame:
    """Rows whose key is on both sides."""
    return left.join(right, key, "inner")


def pair_reporting(left: DataFrame, right: DataFrame, key: str = "utt_id") -> tuple[DataFrame, DataFrame]:
    """Matched rows, and the left rows that were skipped for want of a partner."""
    return left.join(right, key, "inner"), left.join(right, key, "left_anti")


def common_names(a: DataFrame, b: DataFrame, key: str = "name") -> DataFrame:
    """Names on both sides, once each."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def skip_done(df: DataFrame, done: DataFrame, key: str | Sequence[str] = "utt_id") -> DataFrame:
    """Rows whose key has no output yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(done.select(*keys), keys, "left_anti")


def greatest_rows(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` per key, its columns as they are; of rows that tie any one.

    The greatest first part of the order is found by a hash aggregate, so that part must be a number or a time. Rows that have it
    are picked by a join; the other parts of the order decide among the few that are left of a key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first, rest = order[0], [F.desc(c) if isinstance(c, str) else c.desc() for c in order[1:]]
    first = F.col(first) if isinstance(first, str) else first
    rows = df.withColumn("_first", first)
    tops = rows.groupBy(*keys).agg(F.max("_first").alias("_top")).select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_top")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    left = rows.join(tops, [*same, F.col("_first").eqNullSafe(F.col("_top"))])
    nth = F.row_number().over(Window.partitionBy(*[f"_key_{i}" for i in range(len(keys))]).orderBy(F.desc("_top"), *rest))
    return left.withColumn("_nth", nth).where("_nth = 1").select(*df.columns)


def last_wins(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``, whose first column is a number or a time."""
    keys = [key] if isinstance(key, str) else list(key)
    return greatest_rows(df, keys, order).select(*keys, *[c for c in df.columns if c not in keys])


def _sides(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Each key once, with 1 or 0 for either side; repeated keys are merged before they move."""
    sides = inputs.select(key, F.lit(1).alias("_i"), F.lit(0).alias("_o")).unionByName(
        outputs.select(key, F.lit(0).alias("_i"), F.lit(1).alias("_o"))
    )
    return sides.groupBy(key).agg(F.max("_i").alias("_i"), F.max("_o").alias("_o"))


def audit(inputs: DataFrame, outputs: DataFrame, key: str = "utt_id") -> DataFrame:
    """Keys found on one side only, with the side they miss on."""
    alone = _sides(inputs, outputs, key).where("_i <> _o")
    return alone.select(key, F.when(F.col("_i") == 1, "output").otherwise("input").alias("missing_in"))


#: Ranges of keys whose digests are compared, and differing ranges up to which these are divided once more.
RANGES, FEW_RANGES = 4096, 256


def _range_of(key: str, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col(key)), F.lit(RANGES)).cast("int")


def _digests(df: DataFrame, key: str, ranges: Sequence[Column]) -> DataFrame:
    """Per range of keys the count and sums of hashes that don't depend on order; all of fixed width."""
    names = [f"range_{i}" for i in range(len(ranges))]
    low = lambda h: F.sum(F.col(h).bitwiseAND(F.lit((1 << 32) - 1)))
    hashed = df.select(*[r.alias(n) for r, n in zip(ranges, names)], F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("b"), F.col(key)).alias("h2"))
    sums = [F.count(F.lit(1)), F.bit_xor("h1"), F.bit_xor("h2"), low("h1"), low("h2")]
    return hashed.groupBy(*names).agg(*[s.alias(f"d{i}") for i, s in enumerate(sums)])


def _differing(inputs: DataFrame, outputs: DataFrame, key: str, ranges: Sequence[Column]) -> list[tuple[int, ...]]:
    """The ranges in which the two tables differ; at most RANGES at the first level, RANGES * FEW_RANGES at the second."""
    names = [f"range_{i}" for i in range(len(ranges))]
    both = _digests(inputs, key, ranges).unionByName(_digests(outputs, key, ranges))
    # two equal rows, or the range differs
    alike = F.count(F.lit(1)) == 2
    for i in range(5):
        alike &= F.min(f"d{i}") == F.max(f"d{i}")
    return sorted(tuple(r) for r in both.groupBy(*names).agg(alike.alias("alike")).where("NOT alike").select(*names).collect())


def audit_ranges(inputs: DataFrame, outputs: DataFrame, key: str = "utt_id") -> DataFrame:
    """The rows of ``audit``, comparing key by key only where digests differ.

    Each table is reduced to counts and sums of hashes per range of keys. Ranges that differ are divided
    once more where they are few, and only the keys of those that still differ are brought together. Tables that
    hardly differ move hardly any keys. A key that one table repeats makes its range differ, which costs a comparison and
    changes nothing; two different sets of keys pass for equal with a chance of about 2^-128.
    """
    first = _range_of(key, 1)
    found = _differing(inputs, outputs, key, [first])
    wanted = first.isin([f[0] for f in found])
    if found and len(found) <= FEW_RANGES:
        second = _range_of(key, 2)
        pairs = _differing(inputs.where(wanted), outputs.where(wanted), key, [first, second])
        wanted &= (first * RANGES + second).isin([a * RANGES + b for a, b in pairs])
    return audit(inputs.where(wanted), outputs.where(wanted), key)


def audit_summary(inputs: DataFrame, outputs: DataFrame, key: str = "utt_id") -> DataFrame:
    """Counts of input and output keys and of those without counterpart; one row."""
    return _sides(inputs, outputs, key).agg(
        F.coalesce(F.sum("_i"), F.lit(0)).alias("n_input"),
        F.coalesce(F.sum("_o"), F.lit(0)).alias("n_output"),
        F.count_if((F.col("_i") == 1) & (F.col("_o") == 0)).alias("n_missing"),
        F.count_if((F.col("_i") == 0) & (F.col("_o") == 1)).alias("n_extra"),
    )


def assert_complete(inputs: DataFrame, outputs: DataFrame, key: str = "utt_id") -> DataFrame:
    """The summary; running it fails where the two key sets differ."""
    done = audit_summary(inputs, outputs, key)
    complete = (F.col("n_missing") == 0) & (F.col("n_extra") == 0)
    message = F.format_string("%d inputs without output, %d outputs without input", "n_missing", "n_extra")
    return done.where(F.when(complete, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
