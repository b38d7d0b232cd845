"""Writers of records, reports, texts and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voxframe.functions.paths import parent, with_suffix
from voxframe.operators.pairing import skip_done
from voxframe.sources.addresses import has_addresses, missing


def gather(df: DataFrame, by: str) -> DataFrame:
    """Bring the rows of a folder together before a partitioned write.

    Adaptive execution splits a large folder over several tasks and merges small ones, so neither
    one task nor a file per task and folder results.
    """
    return df.hint("rebalance", by)


def write_records(df: DataFrame, path: str, rel_path: str = "rel_path", mode: str = "overwrite") -> None:
    """Nested records as JSON lines below the folder each came from; ``file`` is the record's own name."""
    named = df.withColumn("file", with_suffix(F.col(rel_path), ".json")).withColumn(
        "rel_dir", F.when(parent(F.col(rel_path)) == "", F.lit(".")).otherwise(parent(F.col(rel_path)))
    )
    gather(named, "rel_dir").write.mode(mode).partitionBy("rel_dir").option("ignoreNullFields", False).json(path)


def write_report(summary: DataFrame, details: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A run's averages and its transcripts side by side."""
    root = path.rstrip("/")
    summary.write.mode(mode).option("ignoreNullFields", False).json(f"{root}/summary")
    details.write.mode(mode).option("ignoreNullFields", False).json(f"{root}/details")


def write_texts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", by: str | None = None) -> None:
    """Text per id, one table for all of them."""
    writer = gather(df, by).write.mode(mode).partitionBy(by) if by else df.write.mode(mode)
    writer.format(fmt).save(path)


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What an output already holds; empty before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def write_missing(
    df: DataFrame,
    path: str,
    key: str | list[str],
    key_schema: str,
    by: str | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append the rows whose key the output does not hold yet, transformed; of a key that repeats the first.

    Where ``df`` is a scan of Parquet files, keys and addresses are compared and only missing rows are read, in place. Other
    tables are compared by key, which moves their rows. ``transform`` leaves keys as they are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    done = read_done(df.sparkSession, path, key_schema)
    change = transform or (lambda rows: rows)
    if has_addresses(df):
        for part in missing(df, keys, {"output": done}).parts(df.columns, "output"):
            writer = change(part).write.mode("append")
            (writer.partitionBy(by) if by else writer).parquet(path)
        return
    write_texts(change(skip_done(df, done, keys).dropDuplicates(keys)), path, by=by)


def progress(df: DataFrame, split: str = "split", key: str = "id") -> DataFrame:
    """How many rows of each split are done, and the last key."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_done"), F.max(key).alias("last_key"))


def add_progress(stored: DataFrame, new: DataFrame, split: str = "split") -> DataFrame:
    """Stored counts plus those of this run."""
    both = stored.unionByName(new)
    return both.groupBy(split).agg(F.sum("n_done").alias("n_done"), F.max("last_key").alias("last_key"))
