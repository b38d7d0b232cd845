"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import scratch_path

#: Rows of a lookup table up to which it is sent to every executor; a row is an id and a hash, so this is about 30 MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: no lineage, and executors may come and go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast side only while its counted rows stay under the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
