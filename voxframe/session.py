"""What jobs need from the session: a shared folder, code on the workers, enough tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Spark's own estimate of what opening a file costs, below which it packs splits into one task.
MIN_BYTES_PER_TASK = 4 * 1024 * 1024
# The same where each row takes milliseconds: a task of so many stored bytes takes seconds to a few minutes.
HEAVY_BYTES_PER_TASK, HEAVY_TASKS = 256 * 1024, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a fresh folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
        if named:
            # setCheckpointDir appends a run id; its parent is the folder that was given
            named = named.rsplit("/", 1)[0]
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="voxframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written to the shared folder as Parquet and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package() -> None:
    """Send this package's functions to Python workers by value.

    Unneeded where the package is installed on the cluster or passed with ``--py-files``.
    """
    import voxframe

    cloudpickle.register_pickle_by_value(voxframe)


def input_bytes(df: DataFrame) -> int:
    """Estimated size of all that a plan reads; very large where it is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def range_partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, fewer for small inputs: explicit ones are not merged later."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(most, input_bytes(df) // MIN_BYTES_PER_TASK + 1), min(most, spark.sparkContext.defaultParallelism))


def spread(df: DataFrame, *keys: str, heavy: bool = False) -> DataFrame:
    """Give compute-heavy stages enough tasks when the input is too small to make them.

    A scan splits its files into one task per core from about 4 MB a core upwards. Where all that
    is read is below that, the rows are hashed over the cores, which moves little data; above it
    the scan's own splits are kept and nothing is shuffled. ``heavy`` is for rows that take milliseconds
    each: tasks then get smaller and more with the input, never longer, at the cost of a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if heavy:
        tasks = max(cores, min(-(-input_bytes(df) // HEAVY_BYTES_PER_TASK), HEAVY_TASKS))
        return df.repartition(tasks, *keys) if keys else df.repartition(tasks)
    if input_bytes(df) >= cores * MIN_BYTES_PER_TASK:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)
