"""Outputs that end together: each run writes below its own id, and one row of a log makes it count.

Readers see the runs of the log only, so a run that breaks off between two outputs leaves nothing behind that counts, and
the next one does its work again. One run at a time writes to a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.sinks import add_progress, read_done

LOG = "_log"


def read_log(spark: SparkSession, out: str, progress_schema: str) -> DataFrame:
    """(number, run, progress) of the runs that ended, numbered in order; ``progress`` is what each has added."""
    return read_done(spark, f"{out.rstrip('/')}/{LOG}/runs", f"number long, run string, progress array<struct<{progress_schema}>>")


def ended_runs(spark: SparkSession, out: str) -> list[str]:
    """Ids of the runs that ended, in order; one per run."""
    log = read_done(spark, f"{out.rstrip('/')}/{LOG}/runs", "number long, run string")
    return [r.run for r in log.orderBy("number").collect()]


def read_output(
    spark: SparkSession, out: str, name: str, schema: str, last: bool = False, runs: Sequence[str] | None = None
) -> DataFrame:
    """The rows of one output that count, or those of the last run; other runs are not read.

    ``runs`` are those of ``ended_runs`` where they are known already.
    """
    runs = ended_runs(spark, out) if runs is None else list(runs)
    rows = read_done(spark, f"{out.rstrip('/')}/{name}", f"{schema}, run string")
    return rows.where(F.col("run").isin(runs[-1:] if last else runs)).drop("run")


def append_run(df: DataFrame, out: str, name: str, run: str, by: str | None = None) -> None:
    """Add rows to an output of a run; they stay where their task is."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(f"{out.rstrip('/')}/{name}/run={run}")


def write_together(
    spark: SparkSession,
    out: str,
    outputs: Mapping[str, Callable[[str], None]],
    progress: Callable[[str], DataFrame],
    number: int,
    before: Callable[[str], None] | None = None,
) -> None:
    """Write several outputs, each by a function of the run's id, then the log row that makes all of them count.

    ``progress`` gives what the run has added (a few rows, one per split); ``before`` hears the name of each
    output as its turn comes; ``number`` is how many runs have ended.
    """
    run = uuid.uuid4().hex
    for name, write in outputs.items():
        if before:
            before(name)
        write(run)
    added = progress(run)
    row = added.agg(F.collect_list(F.struct(*added.columns)).alias("progress"))
    row = row.select(F.lit(number).cast("long").alias("number"), F.lit(run).alias("run"), "progress")
    row.write.mode("append").parquet(f"{out.rstrip('/')}/{LOG}/runs")


def total_progress(spark: SparkSession, out: str, split: str, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """The counts of all runs that ended, added up by split, and the last key of each."""
    log = read_log(spark, out, f"`{split}`: {kinds[split]}, n_done: bigint, last_key: {kinds[key]}")
    runs = log.select(F.inline("progress"))
    return add_progress(runs.limit(0), runs, split)
