"""Order, first n, all but the first n, and running numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import range_partitions, stored


def order_by_key(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def first_n(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The first ``n`` rows in key order; every task keeps its own ``n`` before they are merged."""
    return df.orderBy(*keys).limit(n)


def _repeats(column: pa.Array) -> np.ndarray:
    """Which values are the same as the one before; null is the same as null."""
    this, last = column[1:], column[:-1]
    nulls = pc.and_(pc.is_null(this), pc.is_null(last))
    return np.concatenate([[False], pc.or_(pc.fill_null(pc.equal(this, last), False), nulls).to_numpy(zero_copy_only=False)])


def _number_runs(
    group: Sequence[str], order: Sequence[str], unique: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``_own``: the number of a row, from 1, among the rows of its group in a sorted partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_row, count = None, None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            groups, orders = [batch.column(g) for g in group], [batch.column(o) for o in order]
            goes_on = np.ones(rows, bool)
            for column in groups:
                goes_on &= _repeats(column)
            first, first_row = tuple(c[0].as_py() for c in groups), tuple(c[0].as_py() for c in orders)
            goes_on[0] = last is not None and first == last
            if unique:
                twice = goes_on.copy()
                for column in orders:
                    twice &= _repeats(column)
                twice[0] = goes_on[0] and first_row == last_row
                if twice.any():
                    at = int(np.flatnonzero(twice)[0])
                    raise ValueError(f"two rows have {[c[at].as_py() for c in groups + orders]} in {[*group, *order]}")
            at = np.arange(rows)
            opened = np.maximum.accumulate(np.where(goes_on, -1, at))
            own = np.where(opened >= 0, at - opened, at + count) + 1
            last, last_row = tuple(c[rows - 1].as_py() for c in groups), tuple(c[rows - 1].as_py() for c in orders)
            count = int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, "_own"])

    return number


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "row_no",
    start: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Running number in ``order`` within each group, without giving a group to one task.

    Only keys are numbered: they are range-partitioned by group and order, so a large group is spread over many
    partitions, each of which numbers its own share; keys and numbers are written once as Parquet to the shared folder.
    Only the last group of a partition can go on in the next one, so a table with one row per partition holds all that must be
    added. The numbers then meet the other columns in one join on the keys, if there are others. ``group + order`` must
    identify a row (else running it fails, where there are other columns); ``partitions`` defaults to the session's shuffle partitions, fewer for small
    inputs.
    """
    keys = [*group, *order]
    others = [c for c in df.columns if c not in keys]
    ranged = df.select(*keys).repartitionByRange(partitions or range_partitions(df), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_own", T.LongType())])
    numbered = ranged.mapInArrow(_number_runs(group, order, bool(others)), schema).withColumn("_id", F.monotonically_increasing_id())
    numbered = stored(numbered, "numbers").withColumn("_part", F.shiftright("_id", 33))

    ends = numbered.groupBy("_part").agg(F.max("_id").alias("_id"))
    ends = numbered.join(ends, ["_part", "_id"]).select("_part", *group, "_own")
    # one row per partition from here on
    following = F.lead("_part").over(Window.orderBy("_part"))
    offsets = (
        ends.select(following.alias("_part"), F.col("_part").alias("_from"), *group, "_own")
        .select("_part", *group, F.sum("_own").over(Window.partitionBy(*group).orderBy("_from")).alias("_before"))
        .where("_part IS NOT NULL")
    )
    same = [F.col("r._part") == F.col("o._part")]
    same += [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in group]
    joined = numbered.alias("r").join(F.broadcast(offsets.alias("o")), same, "left")
    number = (F.col("r._own") + F.coalesce(F.col("_before"), F.lit(0)) + (start - 1)).cast("long").alias(name)
    numbers = joined.select(*[F.col(f"r.`{k}`") for k in keys], number)
    if not others:
        return numbers.select(*df.columns, name)
    met = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    return df.alias("d").join(numbers.alias("n"), met).select("d.*", f"n.{name}")


def skip_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """All rows but the first ``n`` in key order; ``order`` must identify a row.

    Only the keys are numbered, to find the last one to skip; the table itself is filtered where it
    lies. Null keys come first.
    """
    if n <= 0:
        return df
    keys = number_rows(df.select(*order), order, name="_row_no")
    last = keys.where(F.col("_row_no") == n).drop("_row_no").head()
    if last is None:
        return df.limit(0)
    kinds = [df.schema[c].dataType for c in order]
    cut = [F.lit(value).cast(kind) for value, kind in zip(last, kinds)]
    if len(order) > 1:
        return df.where(F.struct(*order) > F.struct(*[c.alias(o) for c, o in zip(cut, order)]))
    return df.where(F.col(order[0]) > cut[0] if last[0] is not None else F.col(order[0]).isNotNull())
