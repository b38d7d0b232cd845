"""Runs that stop and go on: a file stream with a checkpoint, and writes that repeat safely."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.addresses import FILE
from voxframe.sources.sinks import write_missing


def run_new_files(
    spark: SparkSession,
    source: str,
    schema: str,
    work: Callable[[DataFrame], None],
    checkpoint: str,
    fmt: str = "parquet",
    options: Mapping[str, object] | None = None,
    columns: Sequence[str] = ("*",),
) -> None:
    """Hand the ``columns`` of the files of ``source`` that no earlier run has seen to ``work``, then stop.

    The checkpoint remembers finished files, so nothing else is read. A batch is handed over again
    after a failure: ``work`` must bear that.
    """
    run = (
        spark.readStream.format(fmt)
        .schema(schema)
        .options(**(options or {}))
        .load(source)
        .select(*columns)
        .writeStream.foreachBatch(lambda batch, _: work(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def resume_run(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    key: str | list[str],
    key_schema: str,
    files_per_batch: int | None = None,
    by: str | None = None,
) -> None:
    """Transform the rows of new Parquet files into ``out``; rows whose key it holds are left alone.

    The stream carries the names of new files; what the output lacks of them is then read where it lies.
    ``transform`` leaves keys as they are.
    """
    options = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}

    def work(batch: DataFrame) -> None:
        files = [r[0] for r in batch.distinct().collect()]  # the names of one batch of files
        rows = batch.sparkSession.read.schema(schema).parquet(source).where(F.col(FILE).isin(files))
        write_missing(rows, out, key, key_schema, by, transform)

    run_new_files(spark, source, schema, work, checkpoint, options=options, columns=[FILE])


def stream_to_table(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what is there, into a table, and return the table."""
    run = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def with_end_mark(tokens: DataFrame, key: str, seq: str) -> DataFrame:
    """Marks the last token of each key in a stored table; lengths come from partial aggregation."""
    ends = tokens.groupBy(key).agg(F.max(seq).alias(seq)).withColumn("is_last", F.lit(True))
    return tokens.join(ends, [key, seq], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))
