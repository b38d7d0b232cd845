"""Catalog of datasets and the datasets themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("skip", T.BooleanType()),
        *[
            T.StructField(n, T.StringType())
            for n in ("id_col", "text_col", "text_column_name", "audio_col", "audio_column_name")
        ],
        T.StructField("splits", T.ArrayType(T.StringType())),
    ]
)


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Dataset entries of a JSON array file; none where the file is missing or malformed."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], CATALOG_SCHEMA)
    # malformed text parses to null, which has no entries
    return files.select(F.inline(F.from_json("value", T.ArrayType(CATALOG_SCHEMA))))


def active_entries(catalog: DataFrame) -> DataFrame:
    """Entries not marked to be skipped."""
    return catalog.where(~F.coalesce("skip", F.lit(False)))


def with_roles(catalog: DataFrame) -> DataFrame:
    """Names of the id, text and audio columns, with their defaults; both spellings are accepted."""
    return catalog.select(
        "path",
        "name",
        "skip",
        F.coalesce("id_col", F.lit("id")).alias("id_col"),
        F.coalesce("text_col", "text_column_name", F.lit("text")).alias("text_col"),
        F.coalesce("audio_col", "audio_column_name", F.lit("audio")).alias("audio_col"),
        "splits",
    )


def scan_dataset(
    spark: SparkSession,
    root: str,
    path: str,
    name: str,
    id_col: str = "id",
    text_col: str = "text",
    audio_col: str = "audio",
    splits: Sequence[str] | None = None,
) -> DataFrame:
    """A dataset's table with its columns under their roles; only the wanted splits are read."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{path}/{name}")
    if "split" not in df.columns:
        df = df.withColumn("split", F.lit(None).cast("string"))
    if splits:
        df = df.where(F.col("split").isin(*splits))
    roles = {"id": id_col, "text": text_col, "audio": audio_col}
    found = [F.col(c).alias(r) for r, c in roles.items() if c in df.columns]
    return df.select("split", *found)


def scan_embeddings(spark: SparkSession, path: str, name: str = "name", vector: str = "embedding") -> DataFrame:
    """One flat vector per name; nested arrays of any depth are flattened."""
    df = spark.read.parquet(path)
    flat, kind = F.col(vector), df.schema[vector].dataType
    while isinstance(kind.elementType, T.ArrayType):
        flat, kind = F.flatten(flat), kind.elementType
    return df.select(F.col(name).alias("name"), flat.alias("embedding"))
