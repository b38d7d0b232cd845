"""Rows known by where they lie: resumed runs compare keys and addresses, and payloads are read in place.

The address of a row is the number of its Parquet file in order of paths and its place in the file, in one integer. What
an output lacks is decided on keys and addresses alone. The payload is then read by a second scan over the files that
hold missing rows: files that are missing whole need nothing more, of the others the rows are picked by their addresses,
sent to the tasks in lots of bounded size. No payload is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voxframe.session import stored

#: Bits of an address for the place in the file.
ROW_BITS = 40
#: Addresses sent to the tasks at once (20 bytes each), and files named in one scan.
ADDRESSES, FILES = 2_000_000, 2_000

FILE, ROW = "_metadata.file_path", "_metadata.row_index"


def _lot() -> Column:
    """Numbers stretches of ADDRESSES rows, one after the other in each file."""
    place = F.col("address").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.shiftleft(F.shiftright("address", ROW_BITS), 20) + F.floor(place / ADDRESSES)


def has_addresses(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of Parquet files with nothing but selections of rows and columns on top."""
    try:
        df.select(FILE, ROW)
    except AnalysisException:
        return False
    return True


def files_of(df: DataFrame) -> list[tuple[str, int]]:
    """The files of a scan in order of paths, with their numbers of rows; no column is read.

    One entry per file comes to the driver, which lists the files of a scan in any case.
    """
    counted = df.select(F.col(FILE).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    return sorted((r.file, r.rows) for r in counted.collect())


def _numbers(spark: SparkSession, files: Sequence[tuple[str, int]]) -> DataFrame:
    """(_file, _number), sent to the tasks while they are few."""
    names = pa.table({"_file": [f for f, _ in files], "_number": pa.array([n for _, n in files], pa.int64())})
    table = spark.createDataFrame(names)
    return F.broadcast(table) if len(files) <= ADDRESSES else table


def addressed(df: DataFrame, key: Sequence[str], files: Sequence[tuple[str, int]]) -> DataFrame:
    """Key columns and ``address`` of every row."""
    rows = df.select(*key, F.col(FILE).alias("_file"), F.col(ROW).alias("place"))
    numbered = rows.join(_numbers(df.sparkSession, [(f, i) for i, (f, _) in enumerate(files)]), "_file")
    return numbered.select(*key, (F.shiftleft("_number", ROW_BITS) + F.col("place")).alias("address"))


@dataclass(frozen=True)
class Missing:
    """What several outputs lack of a table: an address per key, the first of its rows, and a flag per output.

    ``lots`` has (number of the file, lot, rows, the outputs that lack these): one entry per file and combination, or per ADDRESSES rows of a
    large file.
    """

    df: DataFrame
    files: list[tuple[str, int]]
    rows: DataFrame
    lots: list[tuple[int, int, int, frozenset[str]]]

    def parts(self, columns: Sequence[str], lacking: str, having: Sequence[str] = ()) -> Iterator[DataFrame]:
        """The rows that output ``lacking`` lacks, and that all of ``having`` have, in tables that are read where they lie."""
        wanted = [(n, lot, rows) for n, lot, rows, lacks in self.lots if lacking in lacks and not lacks & {*having}]
        per_file: dict[int, int] = {}
        for n, _, rows in wanted:
            per_file[n] = per_file.get(n, 0) + rows
        whole = sorted(n for n, rows in per_file.items() if rows == self.files[n][1])
        if whole and len(whole) == len(self.files):
            yield self.df.select(*columns)
            return
        for at in range(0, len(whole), FILES):
            yield self.df.where(F.col(FILE).isin([self.files[n][0] for n in whole[at : at + FILES]])).select(*columns)
        chosen = F.col(f"`{lacking}`")
        for name in having:
            chosen &= ~F.col(f"`{name}`")
        open_lots: list[tuple[int, int]] = []
        held = 0
        for n, lot, rows in sorted(w for w in wanted if per_file[w[0]] < self.files[w[0]][1]):
            if open_lots and (held + rows > ADDRESSES or len(open_lots) == FILES):
                yield self._picked(open_lots, columns, chosen)
                open_lots, held = [], 0
            open_lots.append((n, lot))
            held += rows
        if open_lots:
            yield self._picked(open_lots, columns, chosen)

    def _picked(self, lots: list[tuple[int, int]], columns: Sequence[str], chosen: Column) -> DataFrame:
        numbers = sorted({n for n, _ in lots})
        names = _numbers(self.df.sparkSession, [(self.files[n][0], n) for n in numbers])
        number, place = F.shiftright("address", ROW_BITS), F.col("address").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
        # at most ADDRESSES rows, as counted, and FILES names
        rows = self.rows.where(chosen & _lot().isin([lot for _, lot in lots])).select(number.alias("_number"), place.alias("_place"))
        here = self.df.where(F.col(FILE).isin([self.files[n][0] for n in numbers]))
        here = here.select(*columns, F.col(FILE).alias("_file"), F.col(ROW).alias("_place"))
        return here.join(names, "_file").join(F.broadcast(rows), ["_number", "_place"], "left_semi").select(*columns)


def missing(df: DataFrame, key: Sequence[str], done: Mapping[str, DataFrame]) -> Missing:
    """What the outputs lack whose keys are ``done``; a key that repeats counts once, with its first row.

    Null is a key like any other. One shuffle of keys and addresses, merged before they move.
    """
    files = files_of(df)
    rows = addressed(df, key, files).select(*key, "address", *[F.lit(0).alias(f"has {o}") for o in done])
    for name, keys in done.items():
        marks = [F.lit(int(o == name)).alias(f"has {o}") for o in done]
        rows = rows.unionByName(keys.select(*key, F.lit(None).cast("long").alias("address"), *marks))
    found = rows.groupBy(*key).agg(F.min("address").alias("address"), *[F.max(f"has {o}").alias(f"has {o}") for o in done])
    lacks = [(F.col(f"`has {o}`") == 0).alias(o) for o in done]
    any_lacks = reduce(Column.__or__, [F.col(f"`{o}`") for o in done])
    left = stored(found.where("address IS NOT NULL").select("address", *lacks).where(any_lacks), "addresses")
    lots = left.groupBy(F.shiftright("address", ROW_BITS).alias("n"), _lot().alias("lot"), *[F.col(f"`{o}`") for o in done])
    listed = [(r["n"], r["lot"], r["count"], frozenset(o for o in done if r[o])) for r in lots.count().collect()]
    return Missing(df, files, left, listed)
